"""Registered queries against their SQL on the smallest tables, and what plans must (not) hold."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from registry import oracles
from registry import views as V
from registry.queries import QUERIES
from threadweave.operators.pairs import support_pairs
from threadweave.operators.sampling import sample_per_stratum
from threadweave.sources.posts import brand_linked, first_per_id

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")

CHECKED = [
    "normalized_posts", "support_pairs", "pair_quality_counters", "conversation_table", "tag_strong_intents",
    "representative_rows", "top_bigrams", "weak_labels", "class_weights", "stratified_split",
    "classification_report", "draft_replies", "escalation_decisions", "judge_validation",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    answer = tables.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(repr([plain(v) for v in r]) for r in answer)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(QUERIES) - set(oracles.build())
    assert without == {"train_logreg", "train_logreg_chars", "train_svm"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_links_are_joined_on_keys(spark):
    posts = V.posts(spark, FOLDER)
    for df in (brand_linked(posts, V.BRAND), support_pairs(posts, V.BRAND)):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@needs_data
def test_hot_groups_are_cut_before_the_shuffle(spark):
    for df in (first_per_id(V.posts(spark, FOLDER)), sample_per_stratum(V.messages(spark, FOLDER).withColumn("s", F.lit("x")), "s", "customer_tweet_id", 3)):
        plan = plan_of(df)
        below = plan[plan.index("Exchange hashpartitioning"):]
        assert "WindowGroupLimit" in below and "Partial" in below


@needs_data
def test_texts_are_matched_once_and_scans_are_narrow(spark):
    plan = plan_of(entry.queries()["weak_training"](spark, FOLDER))
    # one evaluation per branch of the message view, not one per use of the label
    assert plan.count("batter(?:y|ies)|charg(?:e|ing|er)|lightning") <= 6
    scan = plan_of(entry.queries()["escalation_rates"](spark, FOLDER))
    assert "ReadSchema: struct<event_id:bigint>" in scan
