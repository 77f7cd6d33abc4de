import random

import pytest
from pyspark.sql import functions as F

from threadweave.operators.threads import conversation_summary, conversation_table, thread_lines, thread_roots
from tests.test_posts_and_pairs import POST


def model_roots(rows):
    """Roots by the rule: walk up; a walk that meets itself names the thread after its start,
    and every post of a walk shares the result."""
    parent = {i: p for i, p in rows}
    known = {}
    for start, _ in rows:
        seen, at = [], start
        while True:
            if at in known:
                root = known[at]
                break
            seen.append(at)
            up = parent[at]
            if up is None or up not in parent:
                root = at
                break
            if up in seen:
                root = seen[0]
                break
            at = up
        known.update(dict.fromkeys(seen, root))
    return known


def test_roots_match_the_walk_on_random_graphs(spark):
    dice = random.Random(7)
    graph, want = [], {}
    for g in range(400):
        n = dice.randint(1, 9)
        names = [f"{g}_{i}" for i in range(n)]
        links = [(x, dice.choice([None, f"{g}_gone", *names, *names])) for x in names]
        want.update(model_roots(links))
        graph += [(x, p, len(graph) + i) for i, (x, p) in enumerate(links)]
    posts = spark.createDataFrame(graph, "tweet_id string, in_response_to_tweet_id string, ingest_seq bigint")
    got = {r["tweet_id"]: r["conversation_id"] for r in thread_roots(posts).collect()}
    assert got == want


def test_long_chain_and_one_hot_thread(spark):
    chain = [(f"a{i}", f"a{i - 1}" if i else None, i) for i in range(100)]
    star = [(f"b{i}", "b0" if i else None, 1000 + i) for i in range(300)]
    posts = spark.createDataFrame(chain + star, "tweet_id string, in_response_to_tweet_id string, ingest_seq bigint")
    got = {r["conversation_id"]: r["n"] for r in thread_roots(posts).groupBy("conversation_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a0": 100, "b0": 300}


def thread(spark, n, undated=()):
    rows = [
        (f"{i:04d}", "u" if i % 2 == 0 else "desk", i % 2 == 0, None if i in undated else 1_500_000_000 + i * 60,
         f"t{i}", None, None, i)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, POST.replace("created_at timestamp", "created_at bigint"))
    return df.withColumn("created_at", F.timestamp_seconds("created_at")).withColumn("conversation_id", F.lit("0000"))


def test_undated_posts_sort_last(spark):
    row = conversation_table(thread(spark, 5, undated={0})).first()
    assert row["customer_text"] == "t2 ||| t4 ||| t0"
    assert row["first_customer_tweet_id"] == "0002"


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_a_thread_is_one_row_whatever_the_partitions(spark, partitions):
    posts = thread(spark, 400).repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows, lines = conversation_table(posts).collect(), thread_lines(posts).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [f"[{'customer | u' if i % 2 == 0 else 'agent | desk'}] t{i}" for i in range(400)]
    assert len(rows) == 1 and rows[0]["thread_text"].split("\n") == want == [r["line"] for r in lines]
    assert rows[0]["customer_text"] == " ||| ".join(f"t{i}" for i in range(0, 400, 2))
    assert (rows[0]["num_tweets"], rows[0]["num_agent_tweets"], rows[0]["first_agent_tweet_id"]) == (400, 200, "0001")


@pytest.mark.parametrize("seed", range(3))
def test_roots_of_random_forests_and_cycles(spark, seed):
    rng = random.Random(seed)
    parents = {f"p{k}": (f"p{rng.randrange(k)}" if k and rng.random() < 0.95 else None) for k in range(300)}
    parents |= {f"d{k}": f"d{k - 1}" if k else None for k in range(130)} | {f"c{k}": f"c{(k + 1) % 5}" for k in range(5)} | {"t0": "c2", "t1": "t0"}
    order = list(parents)

    def root(x):
        seen = []
        while parents[x] is not None:
            if x in seen:
                return None  # a cycle, named below
            seen.append(x)
            x = parents[x]
        return x

    members = [x for x in order if root(x) is None]
    rows = [(x, "u", True, 0, "t", None, parents[x], k) for k, x in enumerate(order)]
    df = spark.createDataFrame(rows, POST.replace("created_at timestamp", "created_at bigint"))
    got = {r["tweet_id"]: r["conversation_id"] for r in thread_roots(df).collect()}
    assert got == {x: root(x) or members[0] for x in order}


def test_summary_of_nothing_is_zero(spark):
    empty = conversation_table(thread(spark, 1)).filter("false")
    assert tuple(conversation_summary(empty).first()) == (0, 0.0, 0, 0)
