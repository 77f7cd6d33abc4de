"""The registered corpus queries on a small table folder, and the pipeline against its parts."""

import random
import zlib

import pytest

import corpus_pipeline
from tests.llm.test_quality import bad_text, good_text
from threadweave.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    base = tmp_path_factory.mktemp("given")
    docs, labels = [], []
    for k in range(240):
        bad = k % 6 == 0
        docs.append((k, bad_text(rng, 80) if bad else good_text(rng, 120), "en", f"s{k % 3}", 0))
        labels.append((k, int(not bad), 0))
    docs += [(300, docs[1][1], "en", "s0", 0), (301, docs[1][1] + " now", "en", "s0", 0), (302, "too short", "en", "s0", 0), (303, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    pages = [(k, f"https://h{k % 3}.example.com/en/{k}", f"<article><p>Page {k % 20} has words.</p></article>") for k in range(50)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{base}/pages.parquet")
    vectors = [(k, [float(k % 9 + 1), float(k % 4), 1.0], k % 2) for k in range(60)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{base}/embeddings.parquet")
    return str(base)


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("name,table", [
    ("op1_simhash_near_dedup", "documents"), ("op2_url_filters", "pages"), ("op3_quality_classifier", "documents"),
    ("op5_bpe_round_trip", "documents"), ("op6_html_extraction", "pages"), ("op7_token_counts", "documents"),
    ("op8_quality_rules", "documents"), ("op9_warc", "pages"), ("op10_embedding_near_dedup", "embeddings"),
    ("op12_line_dedup", "documents"),
])
def test_queries_give_one_row_per_given_row(spark, folder, name, table):
    key = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}[table]
    got = sorted(r[key] for r in queries.QUERIES[name](spark, folder).collect())
    assert got == sorted(r[key] for r in spark.read.parquet(f"{folder}/{table}.parquet").collect())


def test_classifier_query_never_learns_from_held_out_rows(spark, folder):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_classifier"](spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    model = queries.quality_model(spark, folder)
    assert len(model.labels) == sum(not r["held_out"] for k, r in got.items() if k < 240)
    assert all(r["predicted"] == int(k % 6 != 0) for k, r in got.items() if r["held_out"] and k < 240)


def test_pipeline_keeps_clean_documents_and_packs_them_all(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    after = {}
    given = docs
    for name in ("quality_rules", "quality_classifier", "simhash_near_dedup"):
        docs = stages[name](spark, docs, folder)
        assert docs.columns == given.columns
        after[name] = {r["doc_id"] for r in docs.collect()}
    clean = {k for k in range(240) if k % 6}
    assert after["quality_rules"] == clean | {300, 301} == after["quality_classifier"]
    assert after["simhash_near_dedup"] >= clean and 300 not in after["simhash_near_dedup"]
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == after["simhash_near_dedup"]


def test_near_dedup_stage_keeps_one_of_each_group_whatever_the_ids(spark):
    text, other = "please help me with my bill it is wrong again", "a wholly different message about a lost parcel in town"
    rows = [(5, text), (3, text), (3, text), (None, text), (None, other), (None, other)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("3", text), ("None", other)]
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").collect() == []


def test_near_dedup_stage_drops_a_planted_near_copy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id in (1, 2, 300, 301)")
    got = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, folder).collect()}
    assert got == {1, 2}


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, row_ string, score double, votes string, kept string"


def test_stages_on_nulls_repeats_and_clashing_columns(spark, folder):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [(k, given[k], "en", None, None, "r", "s", 0.5, "v", "k") for k in (1, 1, 2, 6, 300)]
    rows += [(None, given[3], None, "s", 1, None, None, None, None, None), (7, None, "en", "s", 1, "r", "s", 0.5, "v", "k"), (8, "", "en", "s", 1, "r", "s", 0.5, "v", "k")]
    docs = spark.createDataFrame(rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []
        got = stage(spark, docs, folder)
        if name == "best_fit_packing":
            assert sorted((r["doc_id"] or -1) for r in got.collect()) == sorted((r[0] or -1) for r in rows)
            continue
        assert got.columns == docs.columns
        kept = list(map(tuple, got.collect()))
        assert set(kept) <= set(rows)
        if name == "quality_rules":
            assert not any(r[0] in (7, 8) for r in kept)
        if name == "quality_classifier":
            assert sorted(str(r[0]) for r in kept) == sorted(["1", "1", "2", "300", "None", "7", "8"])
        if name == "simhash_near_dedup":
            assert sorted(str(r[0]) for r in kept) == sorted(["1", "2", "6", "None", "7"])
