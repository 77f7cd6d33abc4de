"""Corpus queries: each maps given tables to an operator's interface and its result back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from threadweave.llm.bpe import round_trip_posts
from threadweave.llm.given import KEEP_FROM, document_posts, held_out, quality_model, table, tokenizer_path
from threadweave.llm.html_text import extract_main_text
from threadweave.llm.line_dedup import drop_repeated_lines, insert_posts
from threadweave.llm.packing import pack_posts
from threadweave.llm.quality_neighbours import score_post_neighbours
from threadweave.llm.quality_rules import score_post_quality
from threadweave.llm.ranked_search import search_messages
from threadweave.llm.simhash import near_duplicate_posts
from threadweave.llm.source_divergence import audit_agent_wording
from threadweave.llm.token_counts import count_post_tokens
from threadweave.llm.url_filter import LinkRule, filter_links
from threadweave.llm.vector_dedup import near_duplicate_vectors
from threadweave.llm.warc import archive_pages, read_archives
from threadweave.session import checkpoint_folder, import_on_workers, note_written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LINK_RULES = (
    LinkRule("allow", "com", "/"), LinkRule("block", "example.com", "/en/"), LinkRule("allow", "www.example.com", "/en/"),
    LinkRule("block", "net", "/es/"), LinkRule("block", "net", "/fr/"),
)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, folder: build(import_on_workers(spark), folder)
    return build


@query
def op1_simhash_near_dedup(spark, folder):
    return near_duplicate_posts(document_posts(spark, folder)).withColumnRenamed("tweet_id", "doc_id")


@query
def op2_url_filters(spark, folder):
    links = table(spark, folder, "pages").select(F.col("page_id").alias("tweet_id"), "url")
    return filter_links(links, LINK_RULES).withColumnRenamed("tweet_id", "page_id")


@query
def op3_quality_classifier(spark, folder):
    scored = score_post_neighbours(document_posts(spark, folder), quality_model(spark, folder))
    return scored.select(
        F.col("tweet_id").alias("doc_id"), held_out("tweet_id").alias("held_out"), "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )


@query
def op4_best_fit_packing(spark, folder):
    return pack_posts(document_posts(spark, folder), tokenizer_path()).withColumnRenamed("tweet_id", "doc_id")


@query
def op5_bpe_round_trip(spark, folder):
    return round_trip_posts(document_posts(spark, folder), tokenizer_path()).select(
        F.col("tweet_id").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op6_html_extraction(spark, folder):
    return extract_main_text(table(spark, folder, "pages"))


@query
def op7_token_counts(spark, folder):
    return count_post_tokens(document_posts(spark, folder), tokenizer_path()).withColumnRenamed("tweet_id", "doc_id")


@query
def op8_quality_rules(spark, folder):
    scored = score_post_quality(document_posts(spark, folder))
    return scored.withColumnRenamed("tweet_id", "doc_id").withColumn("votes", F.array_join("votes", ","))


@query
def op9_warc(spark, folder):
    archive = note_written(f"{checkpoint_folder(spark)}/archives/{uuid.uuid4().hex}")
    archive_pages(table(spark, folder, "pages"), archive)
    return read_archives(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_embedding_near_dedup(spark, folder):
    return near_duplicate_vectors(table(spark, folder, "embeddings"))


@query
def op11_source_divergence(spark, folder):
    replies = table(spark, folder, "documents").select(
        F.col("lang").alias("weak_intent"), F.col("source").alias("agent_author_id"), F.col("text").alias("agent_text")
    )
    return audit_agent_wording(replies).withColumnsRenamed({"weak_intent": "lang", "agent_author_id": "source"})


@query
def op12_line_dedup(spark, folder):
    posts = document_posts(spark, folder)
    return drop_repeated_lines(posts, insert_posts(None, posts)).select(
        F.col("tweet_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op13_ranked_search(spark, folder):
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    pairs = table(spark, folder, "documents").select(F.col("doc_id").alias("customer_tweet_id"), F.col("text").alias("customer_text"))
    return search_messages(queries, pairs).withColumnsRenamed({"query_id": "item_id", "customer_tweet_id": "doc_id"})


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


ORACLES["op9_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
    f AS (SELECT hex, min(page_id) AS first_id FROM d GROUP BY hex)
    SELECT page_id, payload_bytes,
        list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + CAST(((CAST('0x' || substr(d.hex, 1 + CAST(5 * i // 4 AS INT), 2) AS INT) >> CAST(3 - 5 * i % 4 AS INT)) & 31) AS INT),
            1)), 'string_agg', '') AS payload_digest,
        CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM d JOIN f USING (hex)
"""

ORACLES["op10_embedding_near_dedup"] = """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
    ),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
    LEFT JOIN n ON n.a = e.vec_id
"""

ORACLES["op11_source_divergence"] = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT lang, source, doc_id, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30),
    langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
    counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
            1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // (g.n + 5 * l.v) AS p, 1 + (1000000000 * CAST(k.n + 5 AS HUGEINT)) // (l.n + 5 * l.v) AS q
        FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (
        SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
        FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
        UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
    ),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES["op12_line_dedup"] = r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    shared AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    m AS (SELECT k.*, shared.key IS NOT NULL AND doc_id <> first_id AS gone FROM k LEFT JOIN shared USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
"""

ORACLES["op13_ranked_search"] = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    size AS (SELECT count(*) AS nd, sum(len(terms)) AS nl FROM d WHERE len(terms) > 0),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, size),
    q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    scored AS (SELECT q.item_id, tf.doc_id, CAST(sum(reps * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * nd) // nl)))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN tf USING (term), size GROUP BY ALL HAVING score > 0)
    SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored) WHERE rank <= 10
"""

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
