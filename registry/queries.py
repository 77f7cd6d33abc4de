"""Every operator as a named query over the given tables: ``(spark, folder) -> DataFrame``.

Doubles are rounded and arrays joined at the end only, so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registry import views as V
from threadweave import fixed_values as FV
from threadweave.functions import judging as J
from threadweave.functions import normalize as N
from threadweave.functions import patterns as P
from threadweave.functions import reply as R
from threadweave.functions.policy import decide_escalation, top_similarity
from threadweave.functions.tokens import adjacent_pairs, char_grams, fold_accents, word_tokens
from threadweave.operators import classifiers as C
from threadweave.operators import metrics as M
from threadweave.operators.linear import fit_associations
from threadweave.operators import pairs as A
from threadweave.operators import profile as E
from threadweave.operators import retrieval as RT
from threadweave.operators import sampling as L
from threadweave.operators import tfidf as TF
from threadweave.operators import threads as G
from threadweave.operators import weak_training as W
from threadweave.plans import runs
from threadweave.session import cut_lineage
from threadweave.sources import posts as S
from threadweave.sources.tables import golden_violations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def seconds(column: str) -> Column:
    return F.unix_timestamp(column).alias(column)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- posts, ids, links --------------------------------------------------------------

@query
def normalize_ids(spark, folder):
    return V.raw_posts(spark, folder).select(
        F.col("ingest_seq").alias("id"),
        *[N.normalize_id(c).alias(c) for c in ("tweet_id", "author_id", "in_response_to_tweet_id")],
    )


@query
def parse_response_ids(spark, folder):
    return V.raw_posts(spark, folder).select(
        F.col("ingest_seq").alias("id"),
        F.array_join(N.parse_response_ids("response_tweet_id"), ",").alias("responses"),
    )


@query
def normalized_posts(spark, folder):
    return V.posts(spark, folder).select(
        "tweet_id", "author_id", "inbound", seconds("created_at"), "text", "response_tweet_id",
        "in_response_to_tweet_id", N.is_customer(V.BRAND).alias("is_customer"),
        N.is_agent(V.BRAND).alias("is_agent"), N.has_text("text").alias("has_text"),
    )


@query
def thread_lines(spark, folder):
    return V.posts(spark, folder).select(
        "tweet_id", N.thread_line("inbound", "author_id", "text").alias("line")
    )


@query
def first_post_per_id(spark, folder):
    """Posts of a conversation share one id here; the first of them is kept."""
    shared = V.posts(spark, folder).withColumn("tweet_id", F.col("author_id"))
    return S.first_per_id(shared).select("tweet_id", "ingest_seq", "text")


@query
def brand_linked_posts(spark, folder):
    return S.brand_linked(V.posts(spark, folder), V.BRAND).select("tweet_id", "author_id", "text")


@query
def support_pairs(spark, folder):
    return A.support_pairs(V.posts(spark, folder), V.BRAND).select(
        "customer_tweet_id", "agent_tweet_id", "customer_text", "agent_text",
        seconds("customer_created_at"), seconds("agent_created_at"), "customer_author_id", "link_source",
    )


@query
def pair_quality_counters(spark, folder):
    return A.pair_quality_counters(V.posts(spark, folder), V.BRAND)


@query
def pair_examples(spark, folder):
    return A.pair_examples(A.support_pairs(V.posts(spark, folder), V.BRAND), 10)


@query
def thread_roots(spark, folder):
    return G.thread_roots(V.posts(spark, folder))


@query
def cycle_roots(spark, folder):
    """Threads whose first post answers the last one: named after their first post."""
    return G.thread_roots(V.circular_posts(spark, folder))


@query
def thread_lines_in_order(spark, folder):
    """The long form of the conversation table, with each line's place in its thread."""
    posts = G.brand_conversations(cut_lineage(S.brand_linked(V.posts(spark, folder), V.BRAND)), V.BRAND)
    place = Window.partitionBy("conversation_id").orderBy(F.col("created_at").isNull(), "created_at", "tweet_id")
    return G.thread_lines(posts).select("conversation_id", "tweet_id", "line", F.row_number().over(place).cast("bigint").alias("place"))


@query
def brand_conversations(spark, folder):
    return G.brand_conversations(V.posts(spark, folder), V.BRAND).select(
        "tweet_id", "conversation_id", "author_id"
    )


def _conversations(spark, folder):
    posts = cut_lineage(S.brand_linked(V.posts(spark, folder), V.BRAND))
    return G.conversation_table(G.brand_conversations(posts, V.BRAND))


@query
def conversation_table(spark, folder):
    return _conversations(spark, folder).select(
        "conversation_id", seconds("created_at"), "num_tweets", "num_customer_tweets", "num_agent_tweets",
        "customer_text", "agent_text", "first_customer_tweet_id", "first_agent_tweet_id", "thread_text",
    )


@query
def conversation_summary(spark, folder):
    return rounded(G.conversation_summary(_conversations(spark, folder)), "avg_tweets_per_conversation")


# --- patterns and profiles ----------------------------------------------------------

def _tags(spark, folder, patterns):
    return P.with_tags(V.messages(spark, folder), "customer_text", patterns).select(
        "customer_tweet_id", F.array_join("tags", ",").alias("tags")
    )


@query
def tag_strong_intents(spark, folder):
    return _tags(spark, folder, None)


@query
def tag_stratify_intents(spark, folder):
    return _tags(spark, folder, FV.STRATIFY_PATTERNS)


@query
def tag_themes(spark, folder):
    return _tags(spark, folder, FV.THEME_PATTERNS)


@query
def tag_discovery(spark, folder):
    return _tags(spark, folder, FV.DISCOVERY_PATTERNS)


@query
def match_matrix(spark, folder):
    rows = P.match_matrix(V.messages(spark, folder), "customer_text", FV.STRATIFY_PATTERNS)
    return rows.select(
        "customer_tweet_id", *FV.TAXONOMY, F.col("n_matched").cast("bigint"), "is_multi", "is_vague"
    )


@query
def boundary_flags(spark, folder):
    text = "customer_text"
    password, lock = P.found(text, FV.PASSWORD_PATTERN), P.found(text, FV.LOCK_PATTERN)
    return V.messages(spark, folder).select(
        "customer_tweet_id", P.found(text, FV.SIM_PATTERN).alias("about_sim"),
        (lock & ~password).alias("lock_only"), (password & ~lock).alias("password_only"),
    )


@query
def reply_cues(spark, folder):
    return V.messages(spark, folder).select(
        "agent_tweet_id", *[c.alias(n) for n, c in P.reply_cues("agent_text").items()]
    )


@query
def proposed_intents(spark, folder):
    tags = P.with_tags(V.messages(spark, folder), "customer_text", FV.STRATIFY_PATTERNS)
    primary = F.coalesce(F.get("tags", F.lit(0)), F.lit(FV.UNCLEAR))
    proposal = tags.select("customer_tweet_id", N.proposed_intent(primary, "tags").alias("proposed_intent"))
    return proposal.withColumn("primary_intent", N.proposed_primary("proposed_intent"))


@query
def theme_counts(spark, folder):
    return rounded(E.theme_counts(V.messages(spark, folder), "customer_text"), "pct")


@query
def match_count_summary(spark, folder):
    return E.match_count_summary(V.messages(spark, folder), "customer_text", FV.DISCOVERY_PATTERNS)


@query
def response_pattern_counts(spark, folder):
    return rounded(E.response_pattern_counts(V.messages(spark, folder), "agent_text"), "pct")


@query
def pattern_overlap(spark, folder):
    return E.pattern_overlap(V.messages(spark, folder), "customer_text", FV.DISCOVERY_PATTERNS)


@query
def separation_samples(spark, folder):
    rows = E.separation_samples(V.messages(spark, folder), "customer_text", "customer_tweet_id")
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query
def multi_match_examples(spark, folder):
    rows = E.multi_match_examples(
        V.messages(spark, folder), "customer_text", "customer_tweet_id", FV.DISCOVERY_PATTERNS
    )
    return rows.withColumn("tags", F.array_join("tags", ","))


@query
def representative_rows(spark, folder):
    rows = E.representative_rows(V.messages(spark, folder), "customer_text", "customer_tweet_id")
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query
def word_token_lists(spark, folder):
    tokens = V.table(spark, folder, "documents").select("doc_id", word_tokens("text").alias("t"))
    return tokens.select(
        "doc_id", F.array_join("t", " ").alias("words"), F.array_join(adjacent_pairs("t"), "|").alias("pairs")
    )


@query
def top_unigrams(spark, folder):
    return E.top_terms(V.messages(spark, folder), "customer_text")


@query
def top_bigrams(spark, folder):
    return E.top_terms(V.messages(spark, folder), "customer_text", pairs=True)


# --- weak labels, samples, splits -----------------------------------------------------

def _labelled(spark, folder):
    return W.weak_labels(V.messages(spark, folder), V.reserved(spark, folder))


@query
def golden_exclusion(spark, folder):
    return W.exclude_ids(V.messages(spark, folder), V.reserved(spark, folder)).select("customer_tweet_id")


@query
def weak_labels(spark, folder):
    return W.weak_labels(V.messages(spark, folder)).select("customer_tweet_id", "weak_intent")


@query
def weak_training(spark, folder):
    return W.weak_training_rows(_labelled(spark, folder))


@query
def weak_intent_counts(spark, folder):
    return W.weak_intent_counts(_labelled(spark, folder)).withColumn("ord", F.col("ord").cast("bigint"))


@query
def weak_training_summary(spark, folder):
    return W.weak_training_summary(
        V.messages(spark, folder), V.reserved(spark, folder), _labelled(spark, folder)
    )


@query
def expanded_weak_labels(spark, folder):
    rows = W.expand_labels(W.weak_labels(V.messages(spark, folder)), FV.STRATIFY_PATTERNS)
    return rows.select("customer_tweet_id", "weak_intent")


@query
def class_weights(spark, folder):
    rows = _labelled(spark, folder).filter("weak_intent IS NOT NULL")
    return rounded(W.class_weights(rows, "weak_intent"), "weight")


@query
def damped_class_weights(spark, folder):
    rows = _labelled(spark, folder).filter("weak_intent IS NOT NULL")
    return rounded(W.class_weights(rows, "weak_intent", "sqrt"), "weight")


@query
def sample_per_stratum(spark, folder):
    rows = L.sample_per_stratum(_weak_rows(spark, folder), "weak_intent", "customer_tweet_id", 5)
    return rows.select("customer_tweet_id", "weak_intent")


def _weak_rows(spark, folder):
    return W.weak_training_rows(_labelled(spark, folder))


@query
def stratified_split(spark, folder):
    rows = L.stratified_split(_training_rows(spark, folder), "weak_intent", "customer_tweet_id")
    return rows.select("customer_tweet_id", "weak_intent", "split")


@query
def annotation_candidates(spark, folder):
    rows = L.annotation_candidates(V.messages(spark, folder))
    return L.export_columns(rows)


@query
def candidate_summary(spark, folder):
    return L.candidate_summary(L.annotation_candidates(V.messages(spark, folder)))


@query
def golden_violations_report(spark, folder):
    """The machine sheet is not annotated, so its empty labels must all be reported."""
    rows = W.weak_labels(V.messages(spark, folder)).select(
        F.col("customer_tweet_id").alias("example_id"), "customer_tweet_id", "customer_text",
        F.when(F.col("customer_tweet_id").startswith("c"), "conversation").otherwise(F.col("weak_intent")).alias("annotator_label"),
    )
    return golden_violations(rows)


# --- features and retrieval ---------------------------------------------------------------

@query
def folded_text(spark, folder):
    return V.table(spark, folder, "documents").select("doc_id", fold_accents(F.lower("text")).alias("folded"))


@query
def unfolded_ligatures(spark, folder):
    """Whole texts written with characters that unfold to several or lie beyond 16 bits: folding takes them back."""
    text = F.lower("text")
    for plain, odd in V.LIGATURES:
        text = F.replace(text, F.lit(plain), F.lit(odd))
    return V.spread_table(spark, folder, "documents").select("doc_id", fold_accents(text).alias("folded"))


@query
def word_and_char_vocabulary(spark, folder):
    """Terms of the union of words, word pairs and character n-grams of every document."""
    return rounded(TF.fit_tfidf(V.spread_table(spark, folder, "documents"), "doc_id", "text", "word+char")[0], "idf")


@query
def tfidf_vocabulary(spark, folder):
    docs = V.spread_table(spark, folder, "documents")
    return rounded(TF.fit_tfidf(docs, "doc_id", "text")[0], "idf")


@query
def tfidf_weights(spark, folder):
    docs = V.spread_table(spark, folder, "documents")
    return rounded(TF.fit_tfidf(docs, "doc_id", "text")[1], "w")


@query
def char_gram_counts(spark, folder):
    """Character n-grams of every document with their counts."""
    return TF.term_frequencies(V.spread_table(spark, folder, "documents"), "doc_id", "text", "char")


@query
def char_tfidf_vocabulary(spark, folder):
    return rounded(TF.fit_tfidf(V.spread_table(spark, folder, "documents"), "doc_id", "text", "char")[0], "idf")


def _corpus(spark, folder):
    doc = F.col("doc_id").cast("string")
    return V.spread_table(spark, folder, "documents").select(
        doc.alias("customer_tweet_id"), F.concat(F.lit("a"), doc).alias("agent_tweet_id"),
        F.col("text").alias("customer_text"), F.col("source").alias("agent_text"),
    )


@query
def tfidf_topk(spark, folder):
    """The five most similar documents of every benchmark text, over whole texts."""
    asked = V.spread_table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    found = RT.retrieve_similar(asked, RT.build_index(_corpus(spark, folder)), 5)
    return rounded(
        found.select("query_id", F.col("rank").cast("bigint"), "customer_tweet_id", "similarity_score"),
        "similarity_score",
    )


@query
def retrieval_index_meta(spark, folder):
    meta = RT.build_index(_corpus(spark, folder), V.reserved(spark, folder)).meta
    return meta.select("n_documents", "n_features", "method", "excluded_golden")


@query
def retrieved_evidence(spark, folder):
    """Evidence arrays for customer turns of the conversations over the pairs of all other turns."""
    pairs = cut_lineage(A.support_pairs(V.posts(spark, folder), V.BRAND))
    asked = pairs.select(F.col("agent_tweet_id").alias("query_id"), F.col("customer_text").alias("text"), "customer_tweet_id")
    rows = RT.evidence_arrays(RT.retrieve_similar(asked, RT.build_index(pairs), 3, own="customer_tweet_id"))
    ids = F.array_join(F.transform("evidence", lambda e: e["agent_tweet_id"]), ",")
    return rows.select("query_id", ids.alias("agent_ids"), F.round(top_similarity("evidence"), 6).alias("top_similarity"))


# --- evaluation -----------------------------------------------------------------------------

@query
def classification_metrics(spark, folder):
    return rounded(
        M.overall_metrics(V.truth(spark, folder), "truth", "pred_a"),
        "accuracy", "macro_precision", "macro_recall", "macro_f1",
    )


@query
def per_label_metrics(spark, folder):
    rows = M.per_label_metrics(V.truth(spark, folder), "truth", "pred_b", ["ok", "low", "toxic"])
    return rounded(rows.withColumn("ord", F.col("ord").cast("bigint")), "precision", "recall", "f1")


@query
def confusion_matrix(spark, folder):
    return M.confusion_matrix(V.truth(spark, folder), "truth", "pred_b")


@query
def confusion_wide(spark, folder):
    return M.confusion_wide(V.truth(spark, folder), "truth", "pred_b", ["ok", "low", "toxic", "long"])


@query
def classification_report(spark, folder):
    rows = M.classification_report(V.truth(spark, folder), "truth", "pred_b", ["ok", "low", "toxic"])
    return rounded(rows, "precision", "recall", "f1")


def _predictions(spark, folder):
    rows = V.truth(spark, folder)
    return M.prediction_table(
        rows.select("example_id", "truth"),
        rows.select("example_id", "pred_a"), rows.select("example_id", F.col("pred_b").alias("pred_a")),
        truth="truth", prediction="pred_a",
    )


@query
def prediction_flags(spark, folder):
    return _predictions(spark, folder)


@query
def model_agreement(spark, folder):
    return rounded(M.agreement(_predictions(spark, folder)), "share")


@query
def better_model(spark, folder):
    rows = V.truth(spark, folder)
    return M.better_model(
        M.overall_metrics(rows, "truth", "pred_a"), M.overall_metrics(rows, "truth", "pred_b")
    )


@query
def accuracy_margin(spark, folder):
    return rounded(M.accuracy_margin(V.truth(spark, folder), "truth", "pred_a"), "accuracy", "margin")


# --- models --------------------------------------------------------------------------------

@query
def softmax_confidence(spark, folder):
    scores = F.array(*[F.col("value") * w - o for w, o in ((0.1, 1.0), (0.05, 0.0), (-0.02, 0.5))])
    weights = V.table(spark, folder, "events").select("event_id", C.softmax(scores).alias("w"))
    return weights.select(
        "event_id", *[F.round(F.get("w", F.lit(i)), 6).alias(f"w{i}") for i in range(3)],
        F.round(F.array_max("w"), 6).alias("confidence_like"),
    )


def _training_rows(spark, folder):
    return cut_lineage(_weak_rows(spark, folder))


def _validated(spark, folder, **options):
    return rounded(
        runs.train_and_validate(_training_rows(spark, folder), **options)[1],
        "accuracy", "macro_precision", "macro_recall", "macro_f1",
    )


@query
def train_logreg(spark, folder):
    return _validated(spark, folder)


@query
def train_logreg_chars(spark, folder):
    return _validated(spark, folder, analyzer="char", weighting="sqrt")


@query
def train_svm(spark, folder):
    return _validated(spark, folder, kind="svm")


@query
def self_training(spark, folder):
    """Rows the rules left open, as a second model labels them that learnt from the first one's confident labels."""
    rows = cut_lineage(_labelled(spark, folder))
    open_rows = rows.filter("weak_intent IS NULL")
    second, added = C.self_train(C.load_weak_training(rows), open_rows, fit=fit_associations)
    scored = second.predict(open_rows.drop("weak_intent")).join(
        added.select("customer_tweet_id", F.col("weak_intent").alias("first_label")), "customer_tweet_id", "left"
    )
    return rounded(scored.select("customer_tweet_id", "first_label", "predicted_intent", "classifier_confidence"), "classifier_confidence")


# --- replies, policy, judging ---------------------------------------------------------------

@query
def reply_sentences(spark, folder):
    return V.posts(spark, folder).select(
        "tweet_id", F.array_join(R.sentences(F.col("text")), "|").alias("sentences")
    )


@query
def instruction_snippets(spark, folder):
    return A.support_pairs(V.posts(spark, folder), V.BRAND).select(
        "agent_tweet_id", F.array_join(R.instruction_snippets(F.col("agent_text")), "|").alias("snippets")
    )


@query
def clarifying_questions(spark, folder):
    return A.support_pairs(V.posts(spark, folder), V.BRAND).select(
        "agent_tweet_id", F.array_join(R.clarifying_questions(F.col("agent_text")), "|").alias("questions")
    )


@query
def draft_replies(spark, folder):
    rows = R.draft_replies(V.drafting_inputs(spark, folder))
    cited = F.array_join(F.transform("reply_evidence", lambda e: e["agent_tweet_id"]), ",")
    return rows.select("example_id", "draft_style", "reply_text", cited.alias("cited"))


@query
def escalation_decisions(spark, folder):
    return decide_escalation(V.policy_inputs(spark, folder)).select(
        "example_id", "decision", "reason_code", "reason"
    )


@query
def escalation_rates(spark, folder):
    rows = decide_escalation(V.policy_inputs(spark, folder)).withColumn(
        "predicted_intent", F.coalesce("predicted_intent", F.lit(FV.UNCLEAR))
    )
    return rounded(M.escalation_rates(rows), "escalation_rate_pct")


@query
def reason_code_shares(spark, folder):
    return rounded(M.value_shares(decide_escalation(V.policy_inputs(spark, folder)), "reason_code"), "pct")


@query
def decision_shares(spark, folder):
    return rounded(M.value_shares(decide_escalation(V.policy_inputs(spark, folder)), "decision"), "pct")


@query
def lowest_confidence(spark, folder):
    return M.lowest_rows(V.policy_inputs(spark, folder), "classifier_confidence").select(
        "example_id", "classifier_confidence"
    )


@query
def lowest_similarity(spark, folder):
    return M.lowest_rows(V.policy_inputs(spark, folder), "top_similarity").select("example_id", "top_similarity")


def _scorer(spark, folder):
    """Coefficients of the weakly labelled messages, in closed form."""
    return fit_associations(C.load_weak_training(_training_rows(spark, folder)))


def _truth(spark, folder, pairs):
    return W.weak_labels(pairs).filter("weak_intent IS NOT NULL").select(
        F.col("agent_tweet_id").alias("example_id"), "customer_tweet_id", "customer_text",
        F.col("weak_intent").alias("annotator_label"),
    )


@query
def linear_predictions(spark, folder):
    """Label and confidence of conversation messages by joins with a coefficient table."""
    pairs = cut_lineage(A.support_pairs(V.posts(spark, folder), V.BRAND))
    scored = _scorer(spark, folder).predict(_truth(spark, folder, pairs))
    return rounded(scored.select("example_id", "annotator_label", "predicted_intent", "classifier_confidence"), "classifier_confidence")


def _scored(spark, folder):
    """Conversation messages through the whole chain, none retrieving itself.

    The model learns from weak labels of other rows, but by the same rules that give the truth here, so
    the figures say how well it imitates the rules.
    """
    pairs = cut_lineage(A.support_pairs(V.posts(spark, folder), V.BRAND))
    return runs.score_messages(_truth(spark, folder, pairs), _scorer(spark, folder), RT.build_index(pairs))


@query
def score_messages(spark, folder):
    return _scored(spark, folder).select(
        "example_id", "predicted_intent", F.round("classifier_confidence", 6).alias("classifier_confidence"),
        F.round("top_similarity", 6).alias("top_similarity"), "reply_status", "reply_text", "decision",
        "reason_code", "reason",
    )


@query
def scoring_report(spark, folder):
    report = runs.decision_report(cut_lineage(_scored(spark, folder).drop("evidence")))
    return rounded(report["rates_by_intent"], "escalation_rate_pct")


def _scored_report(spark, folder):
    return runs.decision_report(cut_lineage(_scored(spark, folder).drop("evidence")))


@query
def scored_reason_shares(spark, folder):
    """Why messages are escalated or answered, over the whole chain."""
    return rounded(_scored_report(spark, folder)["reasons"], "pct")


@query
def scored_decision_shares(spark, folder):
    return rounded(_scored_report(spark, folder)["decisions"], "pct")


@query
def scored_metrics(spark, folder):
    """How well the chain's intents imitate the weak rules."""
    return rounded(_scored_report(spark, folder)["metrics"], "accuracy", "macro_precision", "macro_recall", "macro_f1")


@query
def scored_lowest_similarity(spark, folder):
    """The messages whose best evidence is the weakest; equal to six digits counts as equal."""
    rows = rounded(_scored(spark, folder).select("example_id", "top_similarity"), "top_similarity")
    return M.lowest_rows(rows, "top_similarity")


@query
def scored_judge_requests(spark, folder):
    """Prompts on drafted replies with the evidence that retrieval found for them."""
    rows = runs.judge_requests(_scored(spark, folder))
    return rows.select("example_id", "prompt", F.array_join("valid_evidence_ids", ",").alias("valid_ids"))


def _judged(spark, folder):
    return J.judge_status(J.parse_judgements(V.judge_answers(spark, folder)))


@query
def judge_validation(spark, folder):
    rows = _judged(spark, folder)
    return rows.select(
        "example_id", "error", F.col("relevance_score").cast("bigint"), F.col("groundedness_score").cast("bigint"),
        F.col("helpfulness_score").cast("bigint"), F.col("safety_score").cast("bigint"), "serious_failure_detected",
        "serious_failure_type", F.array_join("cited_evidence_ids", ",").alias("cited"), "judge_reasoning",
    )


@query
def judge_pass_fail(spark, folder):
    return _judged(spark, folder).select("example_id", "average_score", "pass_fail")


@query
def judge_summary(spark, folder):
    return rounded(
        J.judge_summary(_judged(spark, folder)), "pass_rate", "mean_relevance_score",
        "mean_groundedness_score", "mean_helpfulness_score", "mean_safety_score", "mean_average_score",
    )


@query
def judge_prompts(spark, folder):
    rows = V.drafting_inputs(spark, folder)
    return rows.select(
        "example_id",
        J.judge_prompt(
            F.col("customer_text"), F.col("predicted_intent"), F.lit("instructional"), F.lit("escalate"),
            F.lit("the reply"), F.col("evidence"),
        ).alias("prompt"),
        F.array_join(J.evidence_ids(F.col("evidence")), ",").alias("valid_ids"),
    )
