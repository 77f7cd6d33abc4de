"""The same queries as ANSI SQL over the given tables, written apart from the operators.

Only fixed values (labels, patterns, word lists, texts) are shared. Views mirror
``registry.views``.
"""

from __future__ import annotations

import re

from registry import views as V
from threadweave import fixed_values as FV


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if i is None else q(i) for i in items) + "]"


def pick(items: list[str], position: str) -> str:
    return f"{words(items)}[CAST(({position}) % {len(items)} AS INTEGER) + 1]"


def re_ci(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q('(?i-s)' + pattern)})"


def re_cs(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q('(?-s)' + pattern)})"


B = q(V.BRAND)

# --- views ---------------------------------------------------------------------------

RAW_POSTS = f"""
base AS (
  SELECT conv_id, turn, role, text, conv_id * 1000000 + turn AS id FROM conversations
),
p AS (
  SELECT id, CAST(id AS VARCHAR) AS tweet_id,
    CASE role WHEN 'assistant' THEN {B} WHEN 'system' THEN 'other_brand'
      ELSE 'u' || CAST(conv_id AS VARCHAR) END AS author_id,
    role = 'user' AS inbound,
    CASE WHEN conv_id % 23 = 7 AND turn = 2 THEN NULL
      ELSE {V.EPOCH} + conv_id * 3600 + turn * 60 END AS created_at,
    CASE WHEN conv_id % 17 = 0 AND turn = 1 THEN '  '
      WHEN role = 'user' THEN {pick(V.MESSAGES, 'conv_id * 3 + turn')} || ' ' || text
      WHEN role = 'assistant' THEN {pick(V.REPLIES, 'conv_id + turn * 5')} || ' ' || text
      ELSE text END AS text,
    CASE WHEN conv_id % 2 = 0 THEN CAST(id + 1 AS VARCHAR) || '.0, ' || CAST(id + 1 AS VARCHAR) || '-x'
      ELSE CAST(id + 1 AS VARCHAR) END AS response_tweet_id,
    CASE WHEN conv_id % 2 = 0 THEN [CAST(id + 1 AS VARCHAR), CAST(id + 1 AS VARCHAR) || '-x']
      ELSE [CAST(id + 1 AS VARCHAR)] END AS responses,
    CASE WHEN turn = 0 THEN NULL
      WHEN role = 'assistant' AND length(text) % 13 = 0 THEN 'lost' || CAST(id AS VARCHAR)
      WHEN role = 'assistant' AND conv_id % 19 = 0 AND turn >= 3 THEN CAST(id - 2 AS VARCHAR)
      ELSE CAST(id - 1 AS VARCHAR) END AS parent
  FROM base
)"""

LINKED = f"""
seed AS (
  SELECT tweet_id AS s FROM p WHERE author_id = {B}
  UNION SELECT parent FROM p WHERE author_id = {B} AND parent IS NOT NULL
  UNION SELECT unnest(responses) FROM p WHERE author_id = {B}
),
linked AS (
  SELECT * FROM p WHERE author_id = {B} OR tweet_id IN (SELECT s FROM seed)
    OR parent IN (SELECT s FROM seed)
)"""


def roots(source: str) -> str:
    return f"""
walk(tweet_id, here) AS (
  SELECT tweet_id, tweet_id FROM {source}
  UNION ALL
  SELECT w.tweet_id, c.parent FROM walk w JOIN {source} c ON c.tweet_id = w.here
  WHERE c.parent IN (SELECT tweet_id FROM {source})
),
root AS (
  SELECT w.tweet_id, w.here AS conversation_id FROM walk w JOIN {source} c ON c.tweet_id = w.here
  WHERE c.parent IS NULL OR c.parent NOT IN (SELECT tweet_id FROM {source})
)"""


MESSAGES = f"""
m AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS customer_tweet_id, 'a' || CAST(event_id AS VARCHAR) AS agent_tweet_id,
    {pick(V.MESSAGES, 'event_id')} || ' #' || CAST(user_id AS VARCHAR) AS customer_text,
    {pick(V.REPLIES, 'event_id * 5 + user_id')} AS agent_text
  FROM events
  UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR), 'ad' || CAST(doc_id AS VARCHAR), text, {pick(V.REPLIES, 'doc_id')}
  FROM documents
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR),
    'ac' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), text, {pick(V.REPLIES, 'conv_id + turn')}
  FROM conversations WHERE role = 'user'
)"""

RESERVED = """
reserved AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id FROM labels
  UNION SELECT 'e' || CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error'
)"""

TRUTH = """
t AS (
  SELECT 'x' || CAST(doc_id AS VARCHAR) AS example_id,
    CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'ok' END AS truth,
    CASE WHEN text LIKE '%worthless%' THEN 'toxic' WHEN text LIKE '%|%' THEN 'low' ELSE 'ok' END AS pred_a,
    CASE WHEN n_chars < 300 THEN 'low' WHEN n_chars > 9000 THEN 'long' ELSE 'ok' END AS pred_b
  FROM labels JOIN documents USING (doc_id)
)"""

POLICY = f"""
x AS (
  SELECT CAST(event_id AS VARCHAR) AS example_id,
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE {pick(FV.TAXONOMY, 'event_id')} END AS predicted_intent,
    (event_id % 101) / 100.0::DOUBLE AS classifier_confidence,
    CASE WHEN event_id % 11 <> 0 THEN (event_id * 7 % 100) / 100.0::DOUBLE END AS top_similarity,
    {pick(V.STATUSES, 'event_id // 13')} AS given_status,
    coalesce(nullif(trim(given_status), ''), '{FV.NO_REPLY_STATUS}') AS reply_status
  FROM events
)"""

RULING = f"""
ruled AS (
  SELECT *, coalesce(predicted_intent, '{FV.UNCLEAR}') AS label,
    CASE WHEN coalesce(predicted_intent, '{FV.UNCLEAR}') = '{FV.UNCLEAR}' THEN {q(FV.REASON_UNCLEAR[0])}
      WHEN classifier_confidence < 0.65 THEN {q(FV.REASON_LOW_CONFIDENCE[0])}
      WHEN top_similarity IS NULL OR top_similarity < 0.30 THEN {q(FV.REASON_WEAK_RETRIEVAL[0])}
      WHEN reply_status = 'insufficient_evidence' THEN {q(FV.REASON_WEAK_REPLY[0])}
      WHEN reply_status = 'dm_redirect' THEN {q(FV.REASON_HANDOFF[0])}
      ELSE {q(FV.REASON_AUTO[0])} END AS reason_code
  FROM x
),
decided AS (
  SELECT *, CASE WHEN reason_code = {q(FV.REASON_AUTO[0])} THEN 'auto_handle' ELSE 'escalate' END AS decision
  FROM ruled
)"""

FIVE = f"""
ev AS (
  SELECT event_id, r, CAST(event_id AS VARCHAR) AS example_id, {pick(V.MESSAGES, 'event_id')} AS customer_text,
    {pick(FV.TAXONOMY, 'event_id')} AS predicted_intent,
    'c' || event_id || '-' || r AS ev_customer, 'a' || event_id || '-' || r AS ev_agent,
    {pick(V.MESSAGES, 'event_id + r')} AS ev_text,
    CASE WHEN event_type = 'view' THEN '' ELSE {pick(V.REPLIES, 'event_id * 7 + r * r * 3 + user_id')} END AS agent_text,
    ((event_id * 7 + r * 13) % 100) / 100.0::DOUBLE AS similarity
  FROM events, range(0, 5) g(r) WHERE event_type <> 'signup'
)"""


def strong(column: str) -> list[tuple[str, str]]:
    unclear = (
        f"({re_ci(column, FV.UNCLEAR_WHOLE_MESSAGE)} OR (NOT {re_ci(column, FV.PRODUCT_WORD_GUARD)} AND "
        f"({re_ci(column, FV.UNCLEAR_FIX_REQUEST)} OR {re_ci(column, FV.UNCLEAR_GENERIC_FAILURE)})))"
    )
    return [(n, re_ci(column, p)) for n, p in FV.STRONG_PATTERNS] + [(FV.UNCLEAR, unclear)]


def tests(column: str, patterns) -> list[tuple[str, str]]:
    return strong(column) if patterns is None else [(n, re_ci(column, p)) for n, p in patterns]


def flags(column: str, patterns, prefix: str = "h_") -> str:
    return ", ".join(f"{t} AS {prefix}{n}" for n, t in tests(column, patterns))


def tag_list(patterns, prefix: str = "h_") -> str:
    names = FV.TAXONOMY if patterns is None else [n for n, _ in patterns]
    items = ", ".join(f"CASE WHEN {prefix}{n} THEN '{n}' END" for n in names)
    return f"list_filter([{items}], lambda z: z IS NOT NULL)"


def tagged(patterns, column: str = "customer_text", source: str = "m") -> str:
    return (
        f"h AS (SELECT *, {flags(column, patterns)} FROM {source}), "
        f"g AS (SELECT *, {tag_list(patterns)} AS tags FROM h)"
    )


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(p.strip() for p in parts) + " "


# --- the weak label as explicit set logic ---------------------------------------------------

def weak_case() -> str:
    """Evaluated over columns: n0/s1/s2 label lists (matched, settled, without how-to), lower text."""
    def one(drain: str, charge: str, a: str, b: str) -> str:
        return f"CASE WHEN {drain} AND NOT {charge} THEN '{a}' WHEN {charge} AND NOT {drain} THEN '{b}' END"

    money = one(re_cs("lo", FV.PAYMENT_CUE), re_cs("lo", FV.SUBSCRIPTION_CUE), "payment_or_refund", "subscription_management")
    app = f"CASE WHEN {re_cs('lo', FV.MANY_BROKEN_CUE)} THEN 'software_update_issue' WHEN {re_cs('lo', FV.NAMED_APP_CUE)} THEN 'app_issue' END"
    phys = f"CASE WHEN {re_cs('lo', FV.PHYSICAL_CUE)} THEN 'hardware_issue' WHEN {re_cs('lo', FV.UPDATE_CUE)} THEN 'software_update_issue' END"

    def stage(s: str) -> str:
        pairs = " ".join(
            f"WHEN {s} = list_sort(['{a}', '{b}']) THEN {q(w) if w else 'NULL'}" for a, b, w in FV.TWO_LABEL_WINNERS
        )
        return (
            f"WHEN len({s}) = 1 THEN {s}[1] "
            f"WHEN {s} = ['payment_or_refund', 'subscription_management'] THEN {money} "
            f"WHEN {s} = ['app_issue', 'software_update_issue'] THEN {app} "
            f"WHEN {s} = ['hardware_issue', 'software_update_issue'] THEN {phys} {pairs} "
        )

    return (
        "CASE WHEN len(s0) = 0 THEN NULL WHEN conflict AND power IS NULL THEN NULL "
        + stage("s1") + stage("s2")
        + "WHEN list_contains(s2, 'software_update_issue') AND list_contains(s2, 'battery_drain') THEN 'battery_drain' "
        + "WHEN list_contains(s2, 'software_update_issue') AND list_contains(s2, 'charging_issue') THEN 'charging_issue' END"
    )


def weak(source: str = "m") -> str:
    power = (
        f"CASE WHEN {re_cs('lo', FV.DRAIN_CUE)} AND NOT {re_cs('lo', FV.CHARGE_CUE)} THEN 'battery_drain' "
        f"WHEN {re_cs('lo', FV.CHARGE_CUE)} AND NOT {re_cs('lo', FV.DRAIN_CUE)} THEN 'charging_issue' END"
    )
    both = "list_has_all(s0, ['battery_drain', 'charging_issue'])"
    return f"""
w0 AS (SELECT *, {flags('customer_text', None)}, lower(customer_text) AS lo FROM {source}),
w1 AS (SELECT * EXCLUDE (lo), lo, list_sort({tag_list(None)}) AS s0 FROM w0),
w2 AS (SELECT *, {both} AS conflict, {power} AS power FROM w1),
w3 AS (SELECT *, CASE WHEN conflict THEN list_sort(list_append(
    list_filter(s0, lambda z: z NOT IN ('battery_drain', 'charging_issue')), power)) ELSE s0 END AS s1 FROM w2),
w4 AS (SELECT *, list_filter(s1, lambda z: z <> 'howto_or_feature') AS s2 FROM w3),
weak AS (SELECT customer_tweet_id, agent_tweet_id, customer_text, agent_text, {weak_case()} AS weak_intent FROM w4)"""


OPEN = "open_m AS (SELECT * FROM m WHERE customer_tweet_id NOT IN (SELECT id FROM reserved))"
LABELLED = [MESSAGES, RESERVED, OPEN, weak("open_m")]
TRAIN = "train AS (SELECT * FROM weak WHERE weak_intent IS NOT NULL)"


# --- text features -------------------------------------------------------------------------

def tokens_of(table: str, key: str, text: str = "text") -> str:
    return (
        f"SELECT {key} AS k, regexp_extract_all(strip_accents(lower({text})), {q(FV.TFIDF_TOKEN)}) AS tk FROM {table}"
    )


def grams_of(name: str, table: str, key: str, text: str = "text") -> str:
    return f"""
{name}_tok AS ({tokens_of(table, key, text)}),
{name}_gram AS (
  SELECT k, unnest(tk) AS term FROM {name}_tok
  UNION ALL
  SELECT k, tk[i] || ' ' || tk[i + 1] FROM (SELECT k, tk, unnest(range(1, len(tk))) AS i FROM {name}_tok WHERE len(tk) > 1)
),
{name}_tf AS (SELECT k, term, count(*) AS tf FROM {name}_gram GROUP BY k, term)"""


def chars_of(name: str, table: str, key: str, text: str = "text") -> str:
    return f"""
{name}_word AS (
  SELECT k, ' ' || w || ' ' AS pw FROM (
    SELECT {key} AS k, unnest(regexp_extract_all(strip_accents(lower({text})), '\\S+')) AS w FROM {table})
),
{name}_n AS (SELECT k, pw, unnest(range(2, least(5, length(pw)) + 1)) AS n FROM {name}_word),
{name}_gram AS (SELECT k, substring(pw, i, n) AS term FROM (
  SELECT k, pw, n, unnest(range(1, length(pw) - n + 2)) AS i FROM {name}_n)),
{name}_tf AS (SELECT k, term, count(*) AS tf FROM {name}_gram GROUP BY k, term)"""


def vocab_of(name: str, table: str) -> str:
    return f"""
{name}_v AS (
  SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM {table})) / (1.0 + count(*))) + 1.0 AS idf
  FROM {name}_tf GROUP BY term HAVING count(*) >= 2
)"""


def weights_of(name: str, vocab: str) -> str:
    return f"""
{name}_raw AS (SELECT k, term, tf * idf AS r FROM {name}_tf JOIN {vocab} USING (term)),
{name}_len AS (SELECT k, sqrt(sum(r * r)) AS len FROM {name}_raw GROUP BY k),
{name}_w AS (SELECT k, term, r / len AS w FROM {name}_raw JOIN {name}_len USING (k))"""


def topk(corpus: str, corpus_key: str, corpus_text: str, asked: str, asked_key: str, asked_text: str, k: int, own: str | None = None) -> str:
    """``own``: the column of ``asked`` with the customer message whose pairs must not be found."""
    foreign = "WHERE NOT starts_with(doc, own || chr(31))" if own else ""
    asker = f"JOIN (SELECT {asked_key} AS query_id, {own} AS own FROM {asked}) USING (query_id)" if own else ""
    return ", ".join(x.strip() for x in [
        grams_of("c", corpus, corpus_key, corpus_text), vocab_of("c", corpus), weights_of("c", "c_v"),
        grams_of("a", asked, asked_key, asked_text), weights_of("a", "c_v"),
        f"""hit AS (SELECT a_w.k AS query_id, c_w.k AS doc, sum(a_w.w * c_w.w) AS score
          FROM a_w JOIN c_w USING (term) GROUP BY ALL)""",
        f"""fill AS (SELECT {asked_key} AS query_id, d.k AS doc, 0.0 AS score FROM {asked},
          (SELECT {corpus_key} AS k FROM {corpus} ORDER BY 1 LIMIT {20 * k}) d)""",
        "best AS (SELECT query_id, doc, max(score) AS score FROM (SELECT * FROM hit UNION ALL SELECT * FROM fill) " + asker + " " + foreign + " GROUP BY ALL)",
        f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc) AS rank
          FROM best QUALIFY rank <= {k})""",
    ])


# --- metrics ---------------------------------------------------------------------------------

def per_label(pred: str) -> str:
    return f"""
lab AS (SELECT truth AS label FROM t UNION SELECT {pred} FROM t),
pl AS (
  SELECT label, (SELECT count(*) FROM t WHERE truth = label) AS support,
    (SELECT count(*) FROM t WHERE {pred} = label) AS predicted,
    (SELECT count(*) FROM t WHERE truth = label AND {pred} = label) AS hit FROM lab
),
pm AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hit / predicted::DOUBLE END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE hit / support::DOUBLE END AS recall,
    2.0 * hit / (support + predicted)::DOUBLE AS f1 FROM pl
)"""


# --- replies ---------------------------------------------------------------------------------

def trimmed(expression: str) -> str:
    return f"trim({expression}, E' \\t\\n\\r')"


def split_sentences(text: str) -> str:
    marked = f"regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, '\\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda z: {trimmed('z')}), lambda z: z <> '')"


def first_spellings(items: str) -> str:
    return (
        f"list_filter({items}, lambda z, i: list_position(list_transform({items}, lambda y: lower(y)), lower(z)) = i)"
    )


def clean(sentence: str) -> str:
    return f"regexp_replace({sentence}, {q('(?i-s)' + FV.BOILERPLATE)}, '')"


def shorten(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN rtrim(substring({text}, 1, {most - 1})) || '…' ELSE {text} END"


def snippet_steps(source: str, text: str) -> str:
    """sentences -> cleaned -> kept -> shortened, one list per step."""
    keep = (
        f"length(z) >= {FV.SNIPPET_MIN} AND {re_ci('z', FV.INSTRUCTION_CUE)} AND "
        f"(NOT {re_ci('z', FV.DM_CUE)} OR {re_ci('z', FV.DM_BUT_TECHNICAL)})"
    )
    ask = f"(contains(z, '?') OR {re_ci('z', FV.QUESTION_CUE)})"
    keep_q = (
        f"z <> '' AND (NOT {re_ci('z', FV.DM_CUE)} OR contains(lower(z), 'which') OR contains(lower(z), 'what'))"
    )
    cleaned_snippet = "trim(" + clean("z") + ", ' -–')"
    cleaned_question = trimmed(clean("z"))
    return f"""
sn0 AS (SELECT *, {split_sentences(text)} AS parts FROM {source}),
sn1 AS (SELECT *, list_filter(list_transform(parts, lambda z: {cleaned_snippet}), lambda z: {keep}) AS sk,
  list_filter(list_transform(list_filter(parts, lambda z: {ask}), lambda z: {cleaned_question}), lambda z: {keep_q}) AS qk FROM sn0),
sn2 AS (SELECT *, list_transform(sk, lambda z: {shorten('z', FV.SNIPPET_MAX)}) AS ss,
  list_transform(qk, lambda z: {shorten('z', FV.QUESTION_MAX)}) AS qs FROM sn1),
sn AS (SELECT *, {first_spellings('ss')} AS snippets, {first_spellings('qs')} AS questions FROM sn2)"""


def filled(template: str, **parts: str) -> str:
    out = q(template)
    for name, value in parts.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def draft_parts() -> list[str]:
    """From ``ev`` (example_id, r, ev_agent, agent_text) and ``msg`` (example_id, predicted_intent) to ``drafted``."""
    phrase = "replace(predicted_intent, '_', ' ')"
    first_q = "rtrim(questions[1], '?')"
    starts = re_cs(f"lower({first_q})", "^(" + "|".join(FV.DM_QUESTION_STARTS) + ")")
    ask = (
        f"CASE WHEN len(questions) = 0 THEN {q(FV.DM_ASK_DEFAULT)} WHEN length({first_q}) > 100 THEN {q(FV.DM_ASK_LONG)} "
        f"WHEN {starts} THEN {first_q} ELSE {q(FV.DM_ASK_DEFAULT)} END"
    )
    steps = (
        f"{filled(FV.STEPS_OPENING, intent=phrase)} || "
        "coalesce((SELECT string_agg(chr(10) || '- ' || s.u, '' ORDER BY s.i) FROM "
        "(SELECT unnest(snippets[1:3]) AS u, unnest(range(1, len(snippets[1:3]) + 1)) AS i) s), '') || "
        f"CASE WHEN len(snippets) < 2 AND len(questions) > 0 AND length({first_q}) <= 120 "
        f"THEN chr(10) || {filled(FV.STEPS_CONFIRM, ask=first_q)} ELSE '' END || "
        f"CASE WHEN any_dm THEN chr(10) || {q(FV.STEPS_DM_NOTE)} ELSE '' END"
    )
    return [
        f"use AS (SELECT *, trim(agent_text) AS agent FROM ev WHERE trim(agent_text) <> '')",
        snippet_steps("use", "agent"),
        f"""cue AS (SELECT *, {re_ci('agent', FV.DM_CUE)} AS dm, {re_ci('agent', FV.LINK_CUE)} AS link,
            {re_ci('agent', FV.INSTRUCTION_CUE)} AS ins FROM sn)""",
        """per AS (SELECT example_id, count(*) AS n, count(*) FILTER (WHERE ins) AS instructive,
            count(*) FILTER (WHERE NOT ins AND (dm OR link)) AS redirecting, bool_or(dm) AS any_dm,
            flatten(list(snippets ORDER BY r)) AS fs, flatten(list(questions ORDER BY r)) AS fq,
            string_agg(ev_agent, ',' ORDER BY r) AS all_ids,
            string_agg(ev_agent, ',' ORDER BY r) FILTER (WHERE len(snippets) > 0 OR len(questions) > 0 OR dm) AS giving
            FROM cue GROUP BY example_id)""",
        f"per2 AS (SELECT *, {first_spellings('fs')} AS snippets, {first_spellings('fq')} AS questions FROM per)",
        """full_ AS (SELECT msg.example_id, predicted_intent, coalesce(n, 0) AS n, instructive, redirecting, any_dm,
            snippets, questions, all_ids, giving,
            CASE WHEN n IS NULL THEN 'insufficient_evidence'
              WHEN (instructive = 0 OR (redirecting >= instructive AND instructive <= greatest(1, n // 3)))
                AND len(snippets) = 0 THEN 'dm_redirect' ELSE 'instructional' END AS draft_style
            FROM msg LEFT JOIN per2 USING (example_id))""",
        f"""drafted AS (SELECT example_id, draft_style,
      CASE draft_style WHEN 'insufficient_evidence' THEN {filled(FV.NO_EVIDENCE_REPLY, intent=phrase)}
        WHEN 'dm_redirect' THEN {filled(FV.DM_REPLY, intent=phrase, ask=ask, brand=q(FV.BRAND_NAME))} ELSE {steps} END AS reply_text,
      coalesce(giving, all_ids, '') AS cited FROM full_)""",
    ]


RATES = """SELECT label AS predicted_intent, count(*) AS total,
      count(*) FILTER (WHERE decision = 'escalate') AS escalate_count,
      round(100.0 * count(*) FILTER (WHERE decision = 'escalate') / count(*), 6)::DOUBLE AS escalation_rate_pct FROM decided GROUP BY label"""


def linear_parts(p: str, train: str, asked: str) -> list[str]:
    """``{p}_predicted``: label and confidence of ``asked`` by coefficients counted over ``train``."""
    t, b = f"{p}t", f"{p}b"
    return [
        grams_of(t, train, "customer_tweet_id", "customer_text"), vocab_of(t, train),
        f"{p}_prior AS (SELECT weak_intent AS label, ln(count(*) / (SELECT count(*) FROM {train})::DOUBLE) AS intercept FROM {train} GROUP BY 1)",
        f"""{p}_tl AS (SELECT term, weak_intent AS label, sum(tf) AS n FROM {t}_tf JOIN {t}_v USING (term)
          JOIN {train} ON k = customer_tweet_id GROUP BY ALL)""",
        f"""{p}_coef AS (SELECT term, label, 1.5 * ln(1.0 + (n * (SELECT sum(n) FROM {p}_tl)::DOUBLE)
            / (sum(n) OVER (PARTITION BY term) * sum(n) OVER (PARTITION BY label))) AS weight FROM {p}_tl)""",
        grams_of(b, asked, "example_id", "customer_text"), weights_of(b, f"{t}_v"),
        f"""{p}_lin AS (SELECT example_id, r.label, intercept + coalesce(v, 0) AS s FROM {asked} CROSS JOIN {p}_prior r
          LEFT JOIN (SELECT k, label, sum(w * weight) AS v FROM {b}_w JOIN {p}_coef USING (term) GROUP BY ALL) f
          ON f.k = example_id AND f.label = r.label)""",
        f"""{p}_soft AS (SELECT example_id, label, s, exp(s - m0) / sum(exp(s - m0)) OVER (PARTITION BY example_id) AS share,
            rank() OVER (PARTITION BY example_id ORDER BY label) AS place
          FROM (SELECT *, max(s) OVER (PARTITION BY example_id) AS m0 FROM {p}_lin))""",
        f"""{p}_predicted AS (SELECT {asked}.*, x.predicted_intent, x.classifier_confidence FROM {asked} JOIN (
          SELECT example_id, max(share) AS classifier_confidence, arg_max(label, (round(s, 9), -place)) AS predicted_intent
          FROM {p}_soft GROUP BY example_id) x USING (example_id))""",
    ]


def self_training_sql() -> str:
    return with_(
        *LABELLED, TRAIN,
        "open_rows AS (SELECT customer_tweet_id AS example_id, customer_text FROM weak WHERE weak_intent IS NULL AND trim(customer_text) <> '')",
        *linear_parts("f", "train", "open_rows"),
        "added AS (SELECT example_id, predicted_intent AS first_label, customer_text FROM f_predicted WHERE classifier_confidence >= 0.95)",
        """more AS (SELECT customer_tweet_id, customer_text, weak_intent FROM train
          UNION ALL SELECT example_id, customer_text, first_label FROM added)""",
        *linear_parts("s", "more", "open_rows"),
    ) + """SELECT example_id AS customer_tweet_id, first_label, predicted_intent, round(classifier_confidence, 6) AS classifier_confidence
      FROM s_predicted LEFT JOIN (SELECT example_id, first_label FROM added) USING (example_id)"""


def scoring_parts(retrieve: bool = True) -> list[str]:
    """Conversation messages with a weak label: scored by a coefficient table, answered from evidence; ends in ``x``."""
    again = re.sub(r"\bw(\d)\b", r"tw\1", weak("pairs")).replace("weak AS", "tweak AS")
    parts = [
        RAW_POSTS, SECONDS_PAIRS, *LABELLED, TRAIN, again,
        """asked AS (SELECT agent_tweet_id AS example_id, customer_tweet_id, customer_text, weak_intent AS annotator_label
          FROM tweak WHERE weak_intent IS NOT NULL)""",
        *linear_parts("f", "train", "asked"),
    ]
    if not retrieve:
        return parts
    return parts + [
        "corpus AS (SELECT customer_tweet_id || chr(31) || agent_tweet_id AS did, customer_text FROM pairs)",
        topk("corpus", "did", "customer_text", "asked", "example_id", "customer_text", 5, "customer_tweet_id"),
        """ev AS (SELECT query_id AS example_id, rank AS r, pairs.agent_tweet_id AS ev_agent, pairs.agent_text, score AS similarity
          FROM ranked JOIN pairs ON doc = pairs.customer_tweet_id || chr(31) || pairs.agent_tweet_id)""",
        "msg AS (SELECT example_id, predicted_intent FROM f_predicted)", *draft_parts(),
        """x AS (SELECT f_predicted.*, (SELECT max(similarity) FROM ev WHERE ev.example_id = f_predicted.example_id) AS top_similarity,
          draft_style AS reply_status, reply_text FROM f_predicted JOIN drafted USING (example_id))""",
    ]


# --- judging ---------------------------------------------------------------------------------

def judge_ctes() -> list[str]:
    answer = pick(V.JUDGE_ANSWERS, "event_id // 2")
    keys = FV.JUDGE_SCORE_KEYS
    number = "IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE')"
    rules = ["WHEN NOT json_valid(js) THEN 'invalid_json'", "WHEN json_type(js) <> 'OBJECT' THEN 'not_an_object'",
             "WHEN coalesce(json_type(js, '$.scores'), 'NONE') <> 'OBJECT' THEN 'missing_scores'"]
    rules += [f"WHEN json_type(js, '$.scores.{k}') IS NULL THEN 'missing_score:{k}'" for k in keys]
    for k in keys:
        rules.append(f"WHEN NOT json_type(js, '$.scores.{k}') {number} THEN 'score_not_a_number:{k}'")
        v = f"CAST(json_extract_string(js, '$.scores.{k}') AS DOUBLE)"
        rules.append(f"WHEN {v} <> floor({v}) OR {v} < 1 OR {v} > 5 THEN 'score_out_of_range:{k}'")
    rules.append("WHEN coalesce(json_type(js, '$.serious_failure_detected'), 'NONE') <> 'BOOLEAN' THEN 'serious_failure_not_boolean'")
    rules.append("WHEN coalesce(json_type(js, '$.cited_evidence_ids'), 'ARRAY') <> 'ARRAY' THEN 'citations_not_a_list'")
    rules.append("WHEN len(valid) > 0 AND NOT list_has_all(valid, coalesce(CAST(json_extract_string(js, '$.cited_evidence_ids[*]') AS VARCHAR[]), [])) THEN 'unknown_citation'")
    score = {k: f"CASE WHEN ok THEN CAST(CAST(json_extract_string(js, '$.scores.{k}') AS DOUBLE) AS BIGINT) END" for k in keys}
    return [
        f"""j0 AS (SELECT CAST(event_id AS VARCHAR) AS example_id,
          CASE WHEN event_type <> 'signup' THEN replace(replace({answer}, '{{s}}', CAST(event_id % 7 AS VARCHAR)), '{{c}}',
            CASE WHEN event_id % 5 = 0 THEN 'bad' || CAST(event_id AS VARCHAR) ELSE 'ok1' END) END AS raw,
          CASE WHEN event_id % 9 = 0 THEN [] ELSE ['ok1', 'ok2'] END AS valid FROM events)""",
        r"""j1 AS (SELECT *, regexp_replace(regexp_replace(raw, '^```(?:json)?\s*', ''), '\s*```$', '') AS js FROM j0)""",
        f"j2 AS (SELECT *, CASE WHEN raw IS NULL THEN NULL {' '.join(rules)} END AS error FROM j1)",
        "j3 AS (SELECT *, raw IS NOT NULL AND error IS NULL AS ok FROM j2)",
        f"""j4 AS (SELECT example_id, raw, error, ok, {score['relevance']} AS relevance_score, {score['groundedness']} AS groundedness_score,
          {score['helpfulness']} AS helpfulness_score, {score['safety_appropriateness']} AS safety_score,
          CASE WHEN ok THEN CAST(json_extract_string(js, '$.serious_failure_detected') AS BOOLEAN) END AS serious_failure_detected,
          CASE WHEN ok THEN json_extract_string(js, '$.serious_failure_type') END AS serious_failure_type,
          CASE WHEN ok THEN array_to_string(coalesce(CAST(json_extract_string(js, '$.cited_evidence_ids[*]') AS VARCHAR[]), []), ',') END AS cited,
          CASE WHEN ok THEN trim(coalesce(json_extract_string(js, '$.reasoning'), '')) END AS judge_reasoning FROM j3)""",
        """j AS (SELECT *, round((relevance_score + groundedness_score + helpfulness_score + safety_score) / 4.0, 2)::DOUBLE AS average_score,
          CASE WHEN raw IS NULL THEN 'API_RATE_LIMITED' WHEN NOT ok THEN 'INVALID'
            WHEN serious_failure_detected OR least(relevance_score, groundedness_score, helpfulness_score, safety_score) < 3
              OR (relevance_score + groundedness_score + helpfulness_score + safety_score) < 14 THEN 'FAIL' ELSE 'PASS' END AS pass_fail FROM j4)""",
    ]


SECONDS_PAIRS = f"""
pairs AS (
  SELECT c.tweet_id AS customer_tweet_id, a.tweet_id AS agent_tweet_id, {trimmed('c.text')} AS customer_text,
    {trimmed('a.text')} AS agent_text, c.created_at AS customer_created_at, a.created_at AS agent_created_at,
    c.author_id AS customer_author_id,
    CASE WHEN list_contains(c.responses, a.tweet_id) THEN 'agent_parent+customer_response_id' ELSE 'agent_parent' END AS link_source
  FROM p a JOIN p c ON a.parent = c.tweet_id
  WHERE a.author_id = {B} AND NOT a.inbound AND c.inbound AND c.author_id <> {B}
    AND {trimmed('a.text')} <> '' AND {trimmed('c.text')} <> ''
)"""


def candidates(target: int = 200, per_intent: int = 14) -> str:
    """The annotation sheet: queues per stratum in md5 order, filled one after the other by a recursive query."""
    names, t = FV.TAXONOMY, "customer_text"
    plan: list[tuple[str, str | None, int, str, str]] = []  # tag, label, quota, kind, test
    for n in names:
        plan += [(f"stratified:{n}", n, per_intent, "quota", f"h_{n} AND len(tags) = 1"), (f"stratified:{n}", n, per_intent, "second", f"h_{n}")]
    plan += [(f"boundary:{n}", a, FV.BOUNDARY_QUOTA, "quota", f"h_{a} AND h_{b}") for n, a, b in FV.BOUNDARY_POOLS]
    sim, password, lock = (re_ci(t, p) for p in (FV.SIM_PATTERN, FV.PASSWORD_PATTERN, FV.LOCK_PATTERN))
    plan += [
        ("boundary:connectivity_vs_sim", "network_connectivity", FV.SIM_QUOTA, "quota", sim),
        ("boundary:account_lock", "account_access", FV.LOCK_QUOTA, "quota", f"{lock} AND NOT {password}"),
        ("boundary:password_reset", "account_access", FV.PASSWORD_QUOTA, "quota", f"{password} AND NOT {lock}"),
        ("vague_or_unclear", FV.UNCLEAR, FV.VAGUE_QUOTA, "quota", f"h_{FV.UNCLEAR} AND len(tags) <= 1"),
        ("multi_problem", None, FV.MULTI_QUOTA, "quota", "len(tags) >= 2"),
        ("residual_unmatched", FV.UNCLEAR, target, "rest", "len(tags) = 0"),
        ("random_fill", None, target, "rest", "true"),
    ]
    tests = ", ".join(f"CASE WHEN {test} THEN {i} END" for i, (*_, test) in enumerate(plan))
    array = lambda column: words([row[column] for row in plan])
    last = len(plan) - 2
    return f"""
rows AS (SELECT *, customer_tweet_id || ':' || agent_tweet_id AS row_key FROM g),
member AS (SELECT row_key, unnest(list_filter([{tests}], lambda z: z IS NOT NULL)) AS stratum FROM rows),
queues AS (SELECT stratum, list(row_key ORDER BY md5('{FV.SEED}:' || CAST(stratum AS VARCHAR) || ':' || row_key), row_key) AS queue FROM member GROUP BY stratum),
plan AS (SELECT unnest(range({len(plan)})) AS i, unnest([{", ".join(str(row[2]) for row in plan)}]) AS quota, unnest({array(3)}) AS kind),
slots AS (SELECT i, quota, kind, coalesce(queue, CAST([] AS VARCHAR[])) AS queue FROM plan LEFT JOIN queues ON stratum = i),
fill(i, used, n, short) AS (
  SELECT CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT i, used || got, n + len(got), want - len(got) FROM (
    SELECT *, list_filter(queue, lambda k: NOT list_contains(used, k))[1:want] AS got FROM (
      SELECT slots.i, fill.used, fill.n, slots.queue,
        CASE slots.kind WHEN 'rest' THEN greatest({target} - fill.n, 0) WHEN 'second' THEN fill.short ELSE slots.quota END AS want
      FROM fill JOIN slots ON slots.i = fill.i + 1))
),
taken AS (SELECT unnest(used) AS row_key, generate_subscripts(used, 1) AS place FROM fill WHERE i = {len(plan) - 1}),
placed AS (SELECT row_key, place, (SELECT min(i) FROM fill WHERE len(used) >= place) AS stratum FROM taken),
kept AS (SELECT row_key, stratum FROM (
    SELECT *, row_number() OVER (ORDER BY stratum >= {last}, place) AS r, count(*) OVER () AS n FROM placed)
  WHERE n <= {target + FV.TRIM_SLACK} OR r <= {target}),
sheet AS (
  SELECT 'GS-' || lpad(CAST(row_number() OVER (ORDER BY md5('{FV.SEED}:shuffle:' || row_key), row_key) AS VARCHAR), 4, '0') AS example_id,
    customer_tweet_id, agent_tweet_id, customer_text, agent_text, tags, {array(0)}[CAST(stratum AS INT) + 1] AS sampling_tag, len(tags) >= 2 AS is_multi,
    coalesce({array(1)}[CAST(stratum AS INT) + 1], tags[1], '{FV.UNCLEAR}') AS proposed_primary, h_{FV.UNCLEAR} AND len(tags) <= 1 AS vague
  FROM rows JOIN kept USING (row_key)
)"""


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    post = with_(RAW_POSTS)
    out["normalize_ids"] = post + "SELECT id, tweet_id, author_id, parent AS in_response_to_tweet_id FROM p"
    out["parse_response_ids"] = post + "SELECT id, array_to_string(responses, ',') AS responses FROM p"
    out["normalized_posts"] = post + f"""SELECT tweet_id, author_id, inbound, created_at, text, response_tweet_id,
      parent AS in_response_to_tweet_id, inbound AND author_id <> {B} AS is_customer,
      NOT inbound AND author_id = {B} AS is_agent, {trimmed('text')} <> '' AS has_text FROM p"""
    out["thread_lines"] = post + """SELECT tweet_id, '[' || CASE WHEN inbound THEN 'customer' ELSE 'agent' END || ' | ' ||
      author_id || '] ' || text AS line FROM p"""
    out["first_post_per_id"] = post + """SELECT author_id AS tweet_id, id AS ingest_seq, text FROM p
      QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY id) = 1"""
    out["brand_linked_posts"] = with_(RAW_POSTS, LINKED) + "SELECT tweet_id, author_id, text FROM linked"
    out["support_pairs"] = with_(RAW_POSTS, SECONDS_PAIRS) + "SELECT * FROM pairs"
    out["pair_examples"] = with_(RAW_POSTS, SECONDS_PAIRS) + """SELECT customer_tweet_id, agent_tweet_id, customer_text,
      agent_text, link_source FROM pairs ORDER BY customer_created_at NULLS LAST, agent_created_at NULLS LAST, agent_tweet_id LIMIT 10"""
    empty = f"({trimmed('c.text')} = '' OR {trimmed('a.text')} = '')"
    out["pair_quality_counters"] = with_(
        RAW_POSTS,
        f"""v1 AS (SELECT CASE WHEN c.tweet_id IS NULL THEN 'missing' WHEN NOT (c.inbound AND c.author_id <> {B}) THEN 'role'
          WHEN {empty} THEN 'empty' ELSE 'ok' END AS v FROM p a LEFT JOIN p c ON a.parent = c.tweet_id
          WHERE a.author_id = {B} AND NOT a.inbound AND a.parent IS NOT NULL)""",
        f"""v2 AS (SELECT CASE WHEN a.parent IS DISTINCT FROM c.tweet_id THEN 'indirect' WHEN {empty} THEN 'empty' ELSE 'ok' END AS v
          FROM (SELECT *, unnest(responses) AS resp FROM p WHERE inbound AND author_id <> {B}) c
          JOIN p a ON a.tweet_id = c.resp WHERE a.author_id = {B} AND NOT a.inbound)""",
    ) + f"""SELECT (SELECT count(*) FROM p WHERE author_id = {B}) AS brand_tweets,
      (SELECT count(*) FROM p WHERE author_id = {B} AND NOT inbound) AS brand_outbound_tweets,
      (SELECT count(*) FROM v1) + (SELECT count(*) FROM v2 WHERE v <> 'ok') AS candidate_pairs,
      (SELECT count(*) FROM v1 WHERE v = 'ok') AS final_pairs,
      (SELECT count(*) FROM v1 WHERE v = 'missing') AS dropped_missing_parent,
      (SELECT count(*) FROM v1 WHERE v = 'role') AS dropped_parent_not_inbound_customer,
      (SELECT count(*) FROM v1 WHERE v = 'empty') + (SELECT count(*) FROM v2 WHERE v = 'empty') AS dropped_empty_text,
      (SELECT count(*) FROM v2 WHERE v = 'indirect') AS dropped_not_direct_reply,
      (SELECT count(*) FROM v1 WHERE v = 'ok') AS added_via_agent_parent,
      CAST(0 AS BIGINT) AS added_via_customer_response_id, (SELECT count(*) FROM p) AS brand_linked_tweet_rows"""
    out["thread_roots"] = with_(RAW_POSTS, roots("p"), recursive=True) + "SELECT tweet_id, conversation_id FROM root"
    out["cycle_roots"] = """SELECT CAST(conv_id * 1000000 + turn AS VARCHAR) AS tweet_id,
      CAST(conv_id * 1000000 + min(turn) OVER (PARTITION BY conv_id) AS VARCHAR) AS conversation_id FROM conversations"""
    mine = f"conversation_id IN (SELECT conversation_id FROM z WHERE author_id = {B})"
    out["brand_conversations"] = with_(
        RAW_POSTS, roots("p"), "z AS (SELECT p.*, conversation_id FROM p JOIN root USING (tweet_id))", recursive=True
    ) + f"SELECT tweet_id, conversation_id, author_id FROM z WHERE {mine}"
    order = "ORDER BY created_at NULLS LAST, tweet_id"
    conv = with_(
        RAW_POSTS, LINKED, roots("linked"),
        "z AS (SELECT linked.*, conversation_id FROM linked JOIN root USING (tweet_id))",
        f"""ct AS (SELECT conversation_id, min(created_at) AS created_at, count(*) AS num_tweets,
          count(*) FILTER (WHERE inbound) AS num_customer_tweets, count(*) FILTER (WHERE NOT inbound) AS num_agent_tweets,
          coalesce(string_agg(text, ' ||| ' {order}) FILTER (WHERE inbound), '') AS customer_text,
          coalesce(string_agg(text, ' ||| ' {order}) FILTER (WHERE NOT inbound), '') AS agent_text,
          first(tweet_id {order}) FILTER (WHERE inbound) AS first_customer_tweet_id,
          first(tweet_id {order}) FILTER (WHERE NOT inbound) AS first_agent_tweet_id,
          string_agg('[' || CASE WHEN inbound THEN 'customer' ELSE 'agent' END || ' | ' || author_id || '] ' || text, chr(10) {order}) AS thread_text
          FROM z WHERE {mine} GROUP BY conversation_id)""",
        recursive=True,
    )
    out["conversation_table"] = conv + "SELECT * FROM ct"
    out["thread_lines_in_order"] = with_(
        RAW_POSTS, LINKED, roots("linked"), "z AS (SELECT linked.*, conversation_id FROM linked JOIN root USING (tweet_id))",
        recursive=True,
    ) + f"""SELECT conversation_id, tweet_id, '[' || CASE WHEN inbound THEN 'customer' ELSE 'agent' END || ' | ' || author_id || '] ' || text AS line,
      row_number() OVER (PARTITION BY conversation_id {order}) AS place FROM z WHERE {mine}"""
    out["conversation_summary"] = conv + """SELECT count(*) AS num_conversations, round(avg(num_tweets), 6) AS avg_tweets_per_conversation,
      count(*) FILTER (WHERE num_agent_tweets > 0) AS conversations_with_agent_reply,
      count(*) FILTER (WHERE num_customer_tweets > 0) AS conversations_with_customer_message FROM ct"""

    # patterns
    for name, patterns in (("tag_strong_intents", None), ("tag_stratify_intents", FV.STRATIFY_PATTERNS),
                           ("tag_themes", FV.THEME_PATTERNS), ("tag_discovery", FV.DISCOVERY_PATTERNS)):
        out[name] = with_(MESSAGES, tagged(patterns)) + "SELECT customer_tweet_id, array_to_string(tags, ',') AS tags FROM g"
    out["match_matrix"] = with_(MESSAGES, tagged(FV.STRATIFY_PATTERNS)) + (
        "SELECT customer_tweet_id, " + ", ".join(f"h_{n} AS {n}" for n in FV.TAXONOMY)
        + ", len(tags) AS n_matched, len(tags) >= 2 AS is_multi, h_other_or_unclear AND len(tags) <= 1 AS is_vague FROM g"
    )
    sim, pw, lock = (re_ci("customer_text", x) for x in (FV.SIM_PATTERN, FV.PASSWORD_PATTERN, FV.LOCK_PATTERN))
    out["boundary_flags"] = with_(MESSAGES) + (
        f"SELECT customer_tweet_id, {sim} AS about_sim, {lock} AND NOT {pw} AS lock_only, {pw} AND NOT {lock} AS password_only FROM m"
    )
    out["reply_cues"] = with_(MESSAGES) + (
        f"SELECT agent_tweet_id, {re_ci('agent_text', FV.DM_CUE)} AS has_dm, {re_ci('agent_text', FV.LINK_CUE)} AS has_link, "
        f"{re_ci('agent_text', FV.QUESTION_CUE)} AS has_question, {re_ci('agent_text', FV.INSTRUCTION_CUE)} AS has_instruction FROM m"
    )
    out["proposed_intents"] = with_(MESSAGES, tagged(FV.STRATIFY_PATTERNS)) + """SELECT customer_tweet_id,
      'MACHINE_CANDIDATE: ' || coalesce(tags[1], 'other_or_unclear') ||
      CASE WHEN len(tags) > 1 THEN ' (also_matched: ' || array_to_string(tags[2:], ',') || ')' ELSE '' END AS proposed_intent,
      coalesce(tags[1], 'other_or_unclear') AS primary_intent FROM g"""
    sheet = with_(MESSAGES, tagged(FV.STRATIFY_PATTERNS), candidates(), recursive=True)
    out["annotation_candidates"] = sheet + """SELECT example_id, customer_tweet_id, agent_tweet_id, customer_text, agent_text,
      'MACHINE_CANDIDATE: ' || proposed_primary || CASE WHEN len(list_filter(tags, lambda z: z <> proposed_primary)) > 0
        THEN ' (also_matched: ' || array_to_string(list_filter(tags, lambda z: z <> proposed_primary), ',') || ')' ELSE '' END AS proposed_intent,
      '' AS annotator_label, '' AS annotator_notes FROM sheet"""
    out["candidate_summary"] = sheet + f"""SELECT measure, name, count(*) AS n FROM (
      SELECT unnest(list_filter(['n_examples', CASE WHEN is_multi THEN 'n_ambiguous_multi' END,
        CASE WHEN proposed_primary = '{FV.UNCLEAR}' OR vague THEN 'n_vague_unclear_candidates' END,
        CASE WHEN starts_with(sampling_tag, 'boundary') THEN 'n_boundary_tagged' END], lambda z: z IS NOT NULL)) AS measure, 'all' AS name FROM sheet
      UNION ALL SELECT 'per_proposed_intent', proposed_primary FROM sheet
      UNION ALL SELECT 'sampling_tag', sampling_tag FROM sheet) GROUP BY ALL"""
    names = [n for n, _ in FV.THEME_PATTERNS]
    out["theme_counts"] = with_(MESSAGES, tagged(FV.THEME_PATTERNS)) + f"""SELECT theme,
      (SELECT count(*) FROM g WHERE list_contains(CASE WHEN len(tags) = 0 THEN ['other'] ELSE tags END, theme)) AS n,
      (SELECT count(*) FROM g WHERE coalesce(tags[1], 'other') = theme) AS n_primary,
      round(100.0 * (SELECT count(*) FROM g WHERE list_contains(CASE WHEN len(tags) = 0 THEN ['other'] ELSE tags END, theme))
        / (SELECT count(*) FROM g), 6)::DOUBLE AS pct
      FROM (SELECT unnest({words(names + ['other'])}) AS theme)"""
    out["match_count_summary"] = with_(MESSAGES, tagged(FV.DISCOVERY_PATTERNS)) + """SELECT count(*) AS n_rows,
      count(*) FILTER (WHERE len(tags) = 0) AS n_unmatched, count(*) FILTER (WHERE len(tags) = 1) AS n_single,
      count(*) FILTER (WHERE len(tags) >= 2) AS n_multi FROM g"""
    responses = [*FV.RESPONSE_PATTERNS, *FV.EXTRA_RESPONSE_PATTERNS]
    out["response_pattern_counts"] = with_(MESSAGES) + " UNION ALL ".join(
        f"SELECT '{n}' AS pattern, count(*) FILTER (WHERE {re_ci('agent_text', x)}) AS n, "
        f"round(100.0 * count(*) FILTER (WHERE {re_ci('agent_text', x)}) / count(*), 6)::DOUBLE AS pct FROM m"
        for n, x in responses
    )
    disc = [n for n, _ in FV.DISCOVERY_PATTERNS]
    out["pattern_overlap"] = with_(MESSAGES, tagged(FV.DISCOVERY_PATTERNS)) + " UNION ALL ".join(
        f"SELECT '{a}' AS pattern_a, '{b}' AS pattern_b, count(*) FILTER (WHERE h_{a} AND h_{b}) AS n_both FROM g"
        for i, a in enumerate(disc) for b in disc[i + 1:]
    )
    wanted = [(f"{x} NOT {y}", f"h_{x} AND NOT h_{y}") for a, b in FV.NAMED_OVERLAPS for x, y in ((a, b), (b, a))]
    wanted += [(x, f"h_{x}") for x in FV.UNPAIRED_SAMPLES]
    out["separation_samples"] = with_(MESSAGES, tagged(FV.DISCOVERY_PATTERNS)) + " UNION ALL ".join(
        f"(SELECT '{title}' AS sample, row_number() OVER (ORDER BY customer_tweet_id) AS position, customer_tweet_id, customer_text "
        f"FROM g WHERE {test} AND length(customer_text) BETWEEN 35 AND 200 QUALIFY position <= 5)"
        for title, test in wanted
    )
    out["multi_match_examples"] = with_(MESSAGES, tagged(FV.DISCOVERY_PATTERNS)) + """SELECT customer_tweet_id, customer_text,
      array_to_string(tags, ',') AS tags FROM g WHERE len(tags) >= 2 ORDER BY customer_tweet_id LIMIT 10"""
    out["representative_rows"] = with_(
        MESSAGES, tagged(FV.THEME_PATTERNS),
        "e AS (SELECT customer_tweet_id, customer_text, unnest(CASE WHEN len(tags) = 0 THEN ['other'] ELSE tags END) AS theme, "
        "length(customer_text) BETWEEN 40 AND 220 AS in_band FROM g)",
        "b AS (SELECT *, bool_or(in_band) OVER (PARTITION BY theme) AS any_in FROM e)",
    ) + """SELECT theme, row_number() OVER (PARTITION BY theme ORDER BY customer_tweet_id) AS position, customer_tweet_id, customer_text
      FROM b WHERE in_band OR NOT any_in QUALIFY position <= 8"""
    tok = f"list_filter(regexp_extract_all(lower({{}}), {q(FV.WORD_TOKEN)}), lambda z: length(z) > 2 AND NOT list_contains({words(FV.STOPWORDS)}, z))"
    out["word_token_lists"] = (
        f"WITH k AS (SELECT doc_id, {tok.format('text')} AS t FROM documents) SELECT doc_id, array_to_string(t, ' ') AS words, "
        "array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|') AS pairs FROM k"
    )
    toks = f"k AS (SELECT {tok.format('customer_text')} AS t FROM m)"
    out["top_unigrams"] = with_(MESSAGES, toks) + """SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM k)
      GROUP BY term ORDER BY n DESC, term LIMIT 40"""
    out["top_bigrams"] = with_(MESSAGES, toks) + """SELECT term, count(*) AS n FROM (
      SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM k)
      GROUP BY term ORDER BY n DESC, term LIMIT 40"""

    # weak labels and samples
    out["golden_exclusion"] = with_(MESSAGES, RESERVED, OPEN) + "SELECT customer_tweet_id FROM open_m"
    out["weak_labels"] = with_(MESSAGES, weak()) + "SELECT customer_tweet_id, weak_intent FROM weak"
    out["weak_training"] = with_(*LABELLED, TRAIN) + "SELECT customer_tweet_id, agent_tweet_id, customer_text, weak_intent FROM train"
    tax = f"tax AS (SELECT unnest({words(FV.TAXONOMY)}) AS weak_intent, unnest(range(0, {len(FV.TAXONOMY)})) AS ord)"
    out["weak_intent_counts"] = with_(*LABELLED, tax) + """SELECT ord, tax.weak_intent, count(weak.customer_tweet_id) AS n
      FROM tax LEFT JOIN weak USING (weak_intent) GROUP BY ALL"""
    out["weak_training_summary"] = with_(*LABELLED) + """SELECT (SELECT count(*) FROM m) AS total_historical_pairs,
      (SELECT count(*) FROM reserved) AS excluded_golden_customer_tweets, count(*) AS pairs_after_golden_exclusion,
      count(weak_intent) AS labelled_examples, count(*) - count(weak_intent) AS unlabelled_examples FROM weak"""
    loose = "CASE " + " ".join(f"WHEN {re_ci('customer_text', x)} THEN '{n}'" for n, x in FV.STRATIFY_PATTERNS) + " END"
    out["expanded_weak_labels"] = with_(MESSAGES, weak()) + f"SELECT customer_tweet_id, coalesce(weak_intent, {loose}) AS weak_intent FROM weak"
    bal = "(SELECT count(*) FROM train) / ((SELECT count(DISTINCT weak_intent) FROM train) * count(*))::DOUBLE"
    for name, w in (("class_weights", bal), ("damped_class_weights", f"sqrt({bal})")):
        out[name] = with_(*LABELLED, TRAIN) + f"SELECT weak_intent, count(*) AS n, round({w}, 6) AS weight FROM train GROUP BY weak_intent"
    h = "md5('42:' || weak_intent || ':' || customer_tweet_id)"
    out["sample_per_stratum"] = with_(*LABELLED, TRAIN) + f"""SELECT customer_tweet_id, weak_intent FROM train
      QUALIFY row_number() OVER (PARTITION BY weak_intent ORDER BY {h}, customer_tweet_id) <= 5"""
    out["stratified_split"] = with_(*LABELLED, TRAIN) + f"""SELECT customer_tweet_id, weak_intent,
      CASE WHEN row_number() OVER (PARTITION BY weak_intent ORDER BY {h}, customer_tweet_id)
        <= round(0.2 * count(*) OVER (PARTITION BY weak_intent)) THEN 'validation' ELSE 'train' END AS split FROM train"""
    out["golden_violations_report"] = with_(MESSAGES, weak(), """gold AS (SELECT customer_text,
      coalesce(CASE WHEN customer_tweet_id LIKE 'c%' THEN 'conversation' ELSE weak_intent END, '') AS label FROM weak)""") + f"""
      SELECT rule, detail, count(*) AS n FROM (
        SELECT 'empty_label' AS rule, '' AS detail FROM gold WHERE label = ''
        UNION ALL SELECT 'empty_text', '' FROM gold WHERE {trimmed('customer_text')} = ''
        UNION ALL SELECT 'unknown_label', label FROM gold WHERE label <> '' AND NOT list_contains({words(FV.TAXONOMY)}, label)
      ) GROUP BY ALL"""

    # features and retrieval
    out["folded_text"] = "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents"
    out["tfidf_vocabulary"] = with_(grams_of("c", "documents", "doc_id"), vocab_of("c", "documents")) + \
        "SELECT term, df, round(idf, 6) AS idf FROM c_v"
    out["tfidf_weights"] = with_(grams_of("c", "documents", "doc_id"), vocab_of("c", "documents"), weights_of("c", "c_v")) + \
        "SELECT k AS doc_id, term, round(w, 6) AS w FROM c_w"
    out["char_gram_counts"] = with_(chars_of("c", "documents", "doc_id")) + "SELECT k AS doc_id, term, tf FROM c_tf"
    out["char_tfidf_vocabulary"] = with_(chars_of("c", "documents", "doc_id"), vocab_of("c", "documents")) + \
        "SELECT term, df, round(idf, 6) AS idf FROM c_v"
    union = """c_tf AS (SELECT k, 'w:' || term AS term, tf FROM w_tf UNION ALL SELECT k, 'c:' || term, tf FROM g_tf)"""
    out["word_and_char_vocabulary"] = with_(
        grams_of("w", "documents", "doc_id"), chars_of("g", "documents", "doc_id"), union, vocab_of("c", "documents")
    ) + "SELECT term, df, round(idf, 6) AS idf FROM c_v"
    out["unfolded_ligatures"] = "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents"
    out["tfidf_topk"] = with_(topk("(SELECT CAST(doc_id AS VARCHAR) AS did, text FROM documents)", "did", "text",
                                   "(SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark)", "qid", "text", 5)) + \
        "SELECT query_id, rank, doc AS customer_tweet_id, round(score, 6) AS similarity_score FROM ranked"
    out["retrieval_index_meta"] = with_(
        RESERVED, "kept AS (SELECT doc_id, text FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM reserved))",
        grams_of("c", "kept", "doc_id"), vocab_of("c", "kept"),
    ) + """SELECT (SELECT count(*) FROM kept) AS n_documents, (SELECT count(*) FROM c_v) AS n_features,
      'tfidf_cosine' AS method, true AS excluded_golden"""
    out["retrieved_evidence"] = with_(
        RAW_POSTS, SECONDS_PAIRS, "corpus AS (SELECT customer_tweet_id || chr(31) || agent_tweet_id AS did, customer_text FROM pairs)",
        topk("corpus", "did", "customer_text", "pairs", "agent_tweet_id", "customer_text", 3, "customer_tweet_id"),
    ) + """SELECT query_id, string_agg(string_split(doc, chr(31))[2], ',' ORDER BY rank) AS agent_ids,
      round(max(score), 6) AS top_similarity FROM ranked GROUP BY query_id"""

    # evaluation
    out["classification_metrics"] = with_(TRUTH, per_label("pred_a")) + """SELECT round(sum(hit) / sum(support)::DOUBLE, 6) AS accuracy,
      round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
      CAST(sum(support) AS BIGINT) AS n_examples FROM pm"""
    place = "coalesce(list_position(['ok', 'low', 'toxic'], label), 4)"
    out["per_label_metrics"] = with_(TRUTH, per_label("pred_b")) + f"""SELECT label, CAST({place} AS BIGINT) AS ord,
      round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted, hit FROM pm"""
    out["confusion_matrix"] = with_(TRUTH, per_label("pred_b")) + """SELECT a.label AS true_label, b.label AS pred_label,
      (SELECT count(*) FROM t WHERE truth = a.label AND pred_b = b.label) AS n FROM lab a, lab b"""
    out["confusion_wide"] = with_(TRUTH) + "SELECT truth AS true_label, " + ", ".join(
        f"count(*) FILTER (WHERE pred_b = '{x}') AS {x}" for x in ("ok", "low", "toxic", "long")) + " FROM t GROUP BY truth"
    out["classification_report"] = with_(TRUTH, per_label("pred_b")) + """
      SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pm
      UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support)::DOUBLE, 6), round(sum(hit) / sum(support)::DOUBLE, 6),
        round(sum(hit) / sum(support)::DOUBLE, 6), CAST(sum(support) AS BIGINT) FROM pm
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pm
      UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
        round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pm"""
    right = """f AS (SELECT example_id, truth, pred_a AS baseline1_prediction, pred_b AS baseline2_prediction,
      pred_a = truth AS baseline1_correct, pred_b = truth AS baseline2_correct,
      pred_a = truth AND pred_b = truth AS both_correct, pred_a <> truth AND pred_b <> truth AS neither_correct FROM t)"""
    out["prediction_flags"] = with_(TRUTH, right) + "SELECT * FROM f"
    cases = [("both_correct", "both_correct"), ("neither_correct", "neither_correct"),
             ("baseline1_only", "baseline1_correct AND NOT baseline2_correct"),
             ("baseline2_only", "baseline2_correct AND NOT baseline1_correct")]
    out["model_agreement"] = with_(TRUTH, right) + " UNION ALL ".join(
        f"SELECT '{n}' AS outcome, count(*) FILTER (WHERE {x}) AS n, round(count(*) FILTER (WHERE {x}) / count(*)::DOUBLE, 6) AS share FROM f"
        for n, x in cases)
    out["better_model"] = with_(
        TRUTH,
        "one AS (" + with_(per_label("pred_a")) + "SELECT sum(hit) / sum(support)::DOUBLE AS a, avg(f1) AS f FROM pm)",
        "two AS (" + with_(per_label("pred_b")) + "SELECT sum(hit) / sum(support)::DOUBLE AS a, avg(f1) AS f FROM pm)",
    ) + """SELECT CASE WHEN one.a > two.a THEN 'baseline1' ELSE 'baseline2' END AS better_accuracy,
      CASE WHEN one.f > two.f THEN 'baseline1' ELSE 'baseline2' END AS better_macro_f1,
      CASE WHEN one.a > two.a AND one.f > two.f THEN 'baseline1' WHEN one.a <= two.a AND one.f <= two.f THEN 'baseline2'
        ELSE 'split' END AS winner FROM one, two"""
    out["accuracy_margin"] = with_(TRUTH, "a AS (SELECT count(*) AS n, avg((truth = pred_a)::INT) AS acc FROM t)") + \
        "SELECT n AS n_examples, round(acc, 6) AS accuracy, round(1.96 * sqrt(acc * (1 - acc) / n), 6) AS margin FROM a"
    s = ["value * 0.1 - 1.0", "value * 0.05", "value * -0.02 - 0.5"]
    out["softmax_confidence"] = (
        f"WITH s AS (SELECT event_id, {', '.join(f'{x} AS s{i}' for i, x in enumerate(s))} FROM events), "
        "z AS (SELECT *, greatest(s0, s1, s2) AS mx FROM s), "
        "e AS (SELECT event_id, exp(s0 - mx) AS e0, exp(s1 - mx) AS e1, exp(s2 - mx) AS e2 FROM z) "
        "SELECT event_id, " + ", ".join(f"round(e{i} / (e0 + e1 + e2), 6) AS w{i}" for i in range(3))
        + ", round(greatest(e0, e1, e2) / (e0 + e1 + e2), 6) AS confidence_like FROM e"
    )

    # replies, policy, judging
    out["reply_sentences"] = post + f"SELECT tweet_id, array_to_string({split_sentences('text')}, '|') AS sentences FROM p"
    snip = with_(RAW_POSTS, SECONDS_PAIRS, snippet_steps("pairs", "agent_text"))
    out["instruction_snippets"] = snip + "SELECT agent_tweet_id, array_to_string(snippets, '|') AS snippets FROM sn"
    out["clarifying_questions"] = snip + "SELECT agent_tweet_id, array_to_string(questions, '|') AS questions FROM sn"
    asking = f"msg AS (SELECT CAST(event_id AS VARCHAR) AS example_id, {pick(FV.TAXONOMY, 'event_id')} AS predicted_intent FROM events)"
    out["draft_replies"] = with_(FIVE, asking, *draft_parts()) + "SELECT * FROM drafted"
    sim_text = "CASE WHEN top_similarity IS NULL THEN 'None' ELSE printf('%.4f', top_similarity) END"
    reason = f"""CASE reason_code WHEN {q(FV.REASON_UNCLEAR[0])} THEN {q(FV.REASON_UNCLEAR[1])}
        WHEN {q(FV.REASON_LOW_CONFIDENCE[0])} THEN printf({q(FV.REASON_LOW_CONFIDENCE[1])}, classifier_confidence, 0.65::DOUBLE)
        WHEN {q(FV.REASON_WEAK_RETRIEVAL[0])} THEN printf({q(FV.REASON_WEAK_RETRIEVAL[1])}, {sim_text}, 0.30::DOUBLE)
        WHEN {q(FV.REASON_WEAK_REPLY[0])} THEN {q(FV.REASON_WEAK_REPLY[1])}
        WHEN {q(FV.REASON_HANDOFF[0])} THEN {q(FV.REASON_HANDOFF[1])} ELSE {q(FV.REASON_AUTO[1])} END AS reason"""
    out["escalation_decisions"] = with_(POLICY, RULING) + f"SELECT example_id, decision, reason_code, {reason} FROM decided"
    chain = with_(*scoring_parts(), RULING)
    out["linear_predictions"] = with_(*scoring_parts(retrieve=False)) + """SELECT example_id, annotator_label, predicted_intent,
      round(classifier_confidence, 6) AS classifier_confidence FROM f_predicted"""
    out["self_training"] = self_training_sql()
    out["score_messages"] = chain + f"""SELECT example_id, predicted_intent, round(classifier_confidence, 6) AS classifier_confidence,
      round(top_similarity, 6) AS top_similarity, reply_status, reply_text, decision, reason_code, {reason} FROM decided"""
    out["scoring_report"] = chain + RATES
    for name, column in (("scored_reason_shares", "reason_code"), ("scored_decision_shares", "decision")):
        out[name] = chain + f"""SELECT {column}, count(*) AS n,
          round(100.0 * count(*) / (SELECT count(*) FROM decided), 6)::DOUBLE AS pct FROM decided GROUP BY {column}"""
    out["scored_metrics"] = with_(
        *scoring_parts(retrieve=False),
        "t AS (SELECT example_id, annotator_label AS truth, predicted_intent AS pred FROM f_predicted)", per_label("pred"),
    ) + """SELECT round(sum(hit) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
      round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n_examples FROM pm"""
    out["scored_lowest_similarity"] = chain + """SELECT example_id, round(top_similarity, 6) AS top_similarity FROM decided
      ORDER BY round(top_similarity, 6) NULLS LAST, example_id LIMIT 10"""
    out["escalation_rates"] = with_(POLICY, RULING) + RATES
    for name, column in (("reason_code_shares", "reason_code"), ("decision_shares", "decision")):
        out[name] = with_(POLICY, RULING) + f"""SELECT {column}, count(*) AS n,
          round(100.0 * count(*) / (SELECT count(*) FROM decided), 6)::DOUBLE AS pct FROM decided GROUP BY {column}"""
    for name, column in (("lowest_confidence", "classifier_confidence"), ("lowest_similarity", "top_similarity")):
        out[name] = with_(POLICY) + f"SELECT example_id, {column} FROM x ORDER BY {column} NULLS LAST, example_id LIMIT 10"
    judged = with_(*judge_ctes())
    out["judge_validation"] = judged + """SELECT example_id, error, relevance_score, groundedness_score, helpfulness_score, safety_score,
      serious_failure_detected, serious_failure_type, cited, judge_reasoning FROM j"""
    out["judge_pass_fail"] = judged + "SELECT example_id, average_score, pass_fail FROM j"
    means = ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in
                      ("relevance_score", "groundedness_score", "helpfulness_score", "safety_score", "average_score"))
    out["judge_summary"] = judged + f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE pass_fail = 'PASS') AS n_pass,
      count(*) FILTER (WHERE pass_fail = 'FAIL') AS n_fail, count(*) FILTER (WHERE pass_fail = 'API_RATE_LIMITED') AS n_unjudged,
      count(*) FILTER (WHERE pass_fail = 'INVALID') AS n_invalid,
      round(count(*) FILTER (WHERE pass_fail = 'PASS') / count(*) FILTER (WHERE pass_fail IN ('PASS', 'FAIL'))::DOUBLE, 6) AS pass_rate,
      {means} FROM j"""
    block = f"printf({q(FV.EVIDENCE_BLOCK)}, r + 1, ev_agent, ev_customer, similarity, ev_text, agent_text)"
    prompt = f"printf({q(FV.JUDGE_PROMPT)}, customer_text, predicted_intent, 'instructional', 'escalate', coalesce(blocks, 'None'), 'the reply')"
    out["judge_prompts"] = with_(
        FIVE,
        f"b AS (SELECT example_id, string_agg({block}, chr(10) || chr(10) ORDER BY r) AS blocks, string_agg(ev_agent, ',' ORDER BY r) AS ids FROM ev GROUP BY example_id)",
        f"""msg AS (SELECT CAST(event_id AS VARCHAR) AS example_id, {pick(V.MESSAGES, 'event_id')} AS customer_text,
          {pick(FV.TAXONOMY, 'event_id')} AS predicted_intent FROM events)""",
    ) + f"SELECT example_id, {prompt} AS prompt, coalesce(ids, '') AS valid_ids FROM msg LEFT JOIN b USING (example_id)"
    shown = f"printf({q(FV.EVIDENCE_BLOCK)}, rank, p.agent_tweet_id, p.customer_tweet_id, score, p.customer_text, p.agent_text)"
    asked = f"printf({q(FV.JUDGE_PROMPT)}, a.customer_text, predicted_intent, reply_status, decision, coalesce(blocks, 'None'), reply_text)"
    out["scored_judge_requests"] = with_(
        *scoring_parts(), RULING,
        f"""shown AS (SELECT query_id AS example_id, string_agg({shown}, chr(10) || chr(10) ORDER BY rank) AS blocks,
          string_agg(p.agent_tweet_id, ',' ORDER BY rank) AS ids
          FROM ranked JOIN pairs p ON doc = p.customer_tweet_id || chr(31) || p.agent_tweet_id GROUP BY query_id)""",
    ) + f"""SELECT example_id, {asked} AS prompt, coalesce(ids, '') AS valid_ids
      FROM decided JOIN (SELECT example_id, customer_text FROM asked) a USING (example_id) LEFT JOIN shown USING (example_id)"""
    return out
