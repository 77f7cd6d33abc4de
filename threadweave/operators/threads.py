"""Thread reconstruction over reply links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.functions.normalize import thread_line
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

def _links(posts: DataFrame, order: str) -> DataFrame:
    """Every post with the loaded post it answers, or null.

    Posts that answer nothing get a key of their own: a shared null would put them all
    into one task.
    """
    parent = F.col("in_response_to_tweet_id")
    loaded = posts.select(F.col("tweet_id").alias("_key"), F.lit(True).alias("_loaded"))
    return (
        posts.select(
            "tweet_id", parent.alias("_parent"), F.col(order).alias("seq"),
            F.coalesce(parent, F.concat(F.lit("no parent of "), F.col("tweet_id"))).alias("_key"),
        )
        .join(loaded, "_key", "left")
        .select("tweet_id", F.when(F.col("_loaded"), F.col("_parent")).alias("ptr"), "seq",
                F.col("seq").alias("least_seq"))
    )


def _jump(pending: DataFrame, targets: DataFrame, *extra: str) -> DataFrame:
    """Replace every pointer by what it points at, and pass the least sequence number on."""
    return cut_lineage(
        pending.join(targets, "ptr").select(
            "tweet_id", F.col("next").alias("ptr"), "seq",
            F.least("least_seq", "next_seq").alias("least_seq"), *extra,
        )
    )


def _as_targets(pending: DataFrame) -> DataFrame:
    return pending.select(
        F.col("tweet_id").alias("ptr"), F.col("ptr").alias("next"), F.col("least_seq").alias("next_seq")
    )


def _pointed_at(settled: DataFrame, pending: DataFrame) -> DataFrame:
    """The settled posts that an open one points at."""
    return cut_lineage(settled.join(pending.select(F.col("ptr").alias("tweet_id")), "tweet_id", "left_semi"))


def thread_roots(posts: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """G1/G2. ``(tweet_id, conversation_id)`` for every post; ids must be unique.

    Pointer doubling: after r rounds a post points 2^r links up its thread. A post is settled once it
    points at a settled post. The number of rounds is the logarithm of the longest thread. A round
    joins the open posts with the open posts and with those settled posts that an open one points
    at; new pointers are pointers of the round before, so that set only shrinks and a round costs
    what is still open. If a round settles nothing, what is left runs into reply cycles; such
    a component is named after its first post in input order.
    """
    require_columns(posts, ["tweet_id", "in_response_to_tweet_id", order], "posts")
    links = cut_lineage(_links(posts, order))
    finished = links.filter("ptr IS NULL").select("tweet_id", F.col("tweet_id").alias("conversation_id"))
    pending = links.filter("ptr IS NOT NULL")
    settled = finished.join(pending.select(F.col("ptr").alias("tweet_id")), "tweet_id", "left_semi")
    open_rows, rounds = pending.count(), 0
    while open_rows:
        settled_targets = settled.select(
            F.col("tweet_id").alias("ptr"), F.col("conversation_id").alias("next"),
            F.lit(None).cast(links.schema["seq"].dataType).alias("next_seq"), F.lit(True).alias("done"),
        )
        targets = settled_targets.unionByName(_as_targets(pending).withColumn("done", F.lit(False)))
        step = _jump(pending, targets, "done")
        rounds += 1
        new = step.filter("done").select("tweet_id", F.col("ptr").alias("conversation_id"))
        finished = finished.unionByName(new)
        pending = step.filter("NOT done").drop("done")
        still_open = pending.count()
        if still_open == open_rows:
            return finished.unionByName(_cycle_roots(pending, rounds, still_open))
        open_rows = still_open
        if open_rows:
            settled = _pointed_at(settled.unionByName(new), pending)
    return finished


def _cycle_roots(pending: DataFrame, rounds: int, size: int) -> DataFrame:
    """G2. Keep doubling until every pointer has gone round its whole cycle."""
    while 2 ** rounds < size:
        pending = _jump(pending, _as_targets(pending))
        rounds += 1
    # The least sequence number on the cycle itself names the component.
    cycle = pending.select(F.col("tweet_id").alias("ptr"), F.col("least_seq").alias("component"))
    members = pending.join(cycle, "ptr").select("tweet_id", "seq", "component")
    first = members.groupBy("component").agg(F.min_by("tweet_id", "seq").alias("conversation_id"))
    return members.join(first, "component").select("tweet_id", "conversation_id")


def assign_conversation_ids(posts: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """G3."""
    return posts.join(thread_roots(posts, order), "tweet_id")


def brand_conversations(posts: DataFrame, brand: str) -> DataFrame:
    """G5/J4. Whole threads in which the brand wrote at least once."""
    if "conversation_id" not in posts.columns:
        posts = assign_conversation_ids(posts)
    mine = posts.filter(F.col("author_id") == brand).select("conversation_id").distinct()
    return posts.join(mine, "conversation_id", "left_semi")


def thread_lines(posts: DataFrame) -> DataFrame:
    """Every post of every thread as a line with its place, in (created_at, tweet_id) order.

    The long form of the conversation table, for threads too long for one cell: sorted by range, so a
    thread is spread over tasks. Undated posts sort last.
    """
    order = [F.col("conversation_id"), F.col("created_at").isNull(), F.col("created_at"), F.col("tweet_id")]
    return posts.select(
        "conversation_id", "created_at", "tweet_id", thread_line("inbound", "author_id", "text").alias("line")
    ).orderBy(*order)


def conversation_table(posts: DataFrame) -> DataFrame:
    """G4. One row per thread: counts, first ids and texts in (created_at, tweet_id) order.

    One aggregation by thread, whatever its length or the cluster's settings; a thread's text is one
    cell, so it has to fit a row (``thread_lines`` has no such limit). Undated posts sort last.
    """
    post = F.struct(
        F.col("created_at").isNull().alias("undated"), "created_at", "tweet_id", "inbound", "author_id", "text",
    )
    threads = posts.groupBy("conversation_id").agg(
        F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("num_tweets"),
        F.count_if("inbound").alias("num_customer_tweets"), F.array_sort(F.collect_list(post)).alias("posts"),
    )

    def of(customer: bool) -> Column:
        return F.filter("posts", lambda p: p["inbound"] if customer else ~p["inbound"])

    def texts(customer: bool) -> Column:
        return F.array_join(F.transform(of(customer), lambda p: p["text"]), " ||| ")

    def first_id(customer: bool) -> Column:
        return F.get(F.transform(of(customer), lambda p: p["tweet_id"]), F.lit(0))

    lines = F.transform("posts", lambda p: thread_line(p["inbound"], p["author_id"], p["text"]))
    return threads.select(
        "conversation_id", "created_at", "num_tweets", "num_customer_tweets",
        (F.col("num_tweets") - F.col("num_customer_tweets")).alias("num_agent_tweets"),
        texts(True).alias("customer_text"), texts(False).alias("agent_text"),
        first_id(True).alias("first_customer_tweet_id"), first_id(False).alias("first_agent_tweet_id"),
        F.array_join(lines, "\n").alias("thread_text"),
    )


def conversation_summary(conversations: DataFrame) -> DataFrame:
    """G6. One row; zeros when there are no conversations."""
    return conversations.agg(
        F.count(F.lit(1)).alias("num_conversations"),
        F.coalesce(F.avg("num_tweets"), F.lit(0.0)).alias("avg_tweets_per_conversation"),
        F.count_if(F.col("num_agent_tweets") > 0).alias("conversations_with_agent_reply"),
        F.count_if(F.col("num_customer_tweets") > 0).alias("conversations_with_customer_message"),
    )
