"""How far the wording of agents who answer the same intent lies apart, term by term."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.llm.byte_terms import LETTERS, terms_of
from threadweave.llm.salting import salted_join
from threadweave.operators.common import top_per_key
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

SCALE = 1_000_000_000  # shares are whole numbers of this
ENTRIES = 200_000  # terms a task adds up before it hands them on
BLOCK_TERMS = 1024  # terms compared at a time, about
STRIPE = 256  # authors compared with all others at a time, about
COUNTS = "intent string, author string, term binary, tf bigint, df bigint"
APART = "intent string, author string, other string, apart bigint"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per intent and author: how often a term occurs and in how many posts, as sums of this task's posts.

    Each group also gives a row without a term, so that groups without terms are known. Sums
    are handed on whenever they hold ``ENTRIES`` terms, which bounds a task's memory.
    """
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (intent, author), (occurrences, posts) in groups.items():
            terms = [None, *occurrences]
            for column, values in zip(columns, (
                [intent] * len(terms), [author] * len(terms), terms, [0, *occurrences.values()], [0, *map(posts.__getitem__, occurrences)],
            )):
                column.extend(values)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["intent", "author", "term", "tf", "df"])

    for batch in batches:
        for intent, author, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            occurrences, posts = groups.setdefault((intent, author), (Counter(), Counter()))
            held -= len(occurrences)
            frequency = Counter(terms_of(text, LETTERS))  # of this post
            posts.update(frequency.keys())
            for term, n in frequency.items():
                occurrences[term] += n
            held += len(occurrences)
            if held > ENTRIES:
                yield rows()
                groups.clear()
                held = 0
    yield rows()


def _share(count: Column, total: Column, kept: Column, smoothing: int) -> Column:
    """1 + floor(SCALE * (count + smoothing) / (total + smoothing * kept)), exact at any size."""
    wide = "decimal(28,0)"
    top = (count.cast(wide) + smoothing) * F.lit(SCALE).cast("decimal(10,0)")
    below = F.greatest(total + kept * smoothing, F.lit(1))
    return F.call_function("div", top.cast("decimal(38,0)"), below.cast("decimal(38,0)")) + 1


def _stripe(author: Column, stripes: Column) -> Column:
    return F.pmod(F.xxhash64(author), stripes)


def _compare_block(table: pa.Table) -> pa.Table:
    """Summed distances of the shares in one block of terms, of one stripe's authors to all of their intent.

    Rows without a term name the intent's authors with the share of a term they never use.
    """
    named = table.column("term").is_null().to_numpy(zero_copy_only=False)
    author = np.array(table.column("author").to_pylist(), object)
    share = table.column("share").to_numpy()
    mine = table.column("mine").to_numpy(zero_copy_only=False)
    authors, first = np.unique(author[named], return_index=True)
    nothing, asks = share[named][first], mine[named][first]
    terms, row = np.unique(np.array(table.column("term").to_pylist(), object)[~named], return_inverse=True)
    shares = np.tile(nothing, (len(terms), 1))
    shares[row, np.searchsorted(authors, author[~named])] = share[~named]
    left, right, apart = [], [], []
    for a in np.flatnonzero(asks):
        others = np.delete(np.arange(len(authors)), a)
        left.append(np.full(len(others), a))
        right.append(others)
        apart.append(np.abs(shares - shares[:, a:a + 1]).sum(axis=0)[others])
    left, right, apart = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, apart))
    intent = table.column("intent")[0].as_py()
    return pa.table({
        "intent": pa.array([intent] * len(left), pa.string()), "author": pa.array(authors[left], pa.string()),
        "other": pa.array(authors[right], pa.string()), "apart": pa.array(apart, pa.int64()),
    })


def audit_agent_wording(
    replies: DataFrame, intent_column: str = "weak_intent", author_column: str = "agent_author_id",
    text_column: str = "agent_text", min_posts: int = 30, smoothing: int = 5, most_terms: int = 50,
) -> DataFrame:
    """Which agents word their replies to the same intent unlike each other, and by which terms.

    ``replies`` are support pairs with a label (``weak_intent``, ``agent_author_id``, ``agent_text``). A term
    is a run of letters (any character beyond ASCII counts as one), A-Z lower-cased. An intent keeps the
    terms found in at least ``min_posts`` of its replies. Each agent, and the intent as a whole, gives
    every kept term a smoothed share in billionths, plus one. Returned are, in columns named as the
    given ones, ``part``, ``item``, ``value`` and ``rank``:

    * part ``pair``: every other agent of the intent, value the summed distance of all shares;
    * part ``term``: terms the agent uses more than the intent does, value by how much, the
      ``most_terms`` strongest.

    Ranks count from 1 per agent and part, by falling value, then by item.

    Whole texts are tokenised by one byte translation, a split and a count per reply; a task hands on sums, not
    replies, so an agent with a third of all replies costs a sum per term and task. Terms an agent
    never uses all have one share, so only used ones are stored; distances are taken per block of terms.
    The pairs of agents are the result, and the only thing that grows with their square.

    Null intent, agent or text: read as empty; such a group is one like any other. A reply without terms still
    makes its group occur. Repeated rows count as often as they occur. No kept term: all
    distances are 0. An empty table gives no rows. Other columns are not read.
    """
    require_columns(replies, [intent_column, author_column, text_column], "labelled replies")
    spark = replies.sparkSession
    empty = F.lit("")
    read = replies.select(
        F.coalesce(F.col(intent_column).cast("string"), empty).alias("intent"),
        F.coalesce(F.col(author_column).cast("string"), empty).alias("author"),
        F.col(text_column).cast("string").cast("binary").alias("text"),
    )
    # One shuffle by intent and term serves both sums and the choice of terms.
    of_term = Window.partitionBy("intent", "term")
    counted = cut_lineage(
        read.mapInArrow(_count_terms, COUNTS).repartition("intent", "term")
        .groupBy("intent", "term", "author").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .withColumn("all_df", F.sum("df").over(of_term)).withColumn("all_tf", F.sum("tf").over(of_term))
        .withColumn("place", F.row_number().over(of_term.orderBy("author")))
        .filter(F.col("term").isNull() | (F.col("all_df") >= min_posts))
    )
    kept = counted.filter("term is not null")
    intents = counted.groupBy("intent").agg(
        F.sum("tf").alias("intent_total"),
        F.count_if(F.col("term").isNotNull() & (F.col("place") == 1)).alias("n_terms"),
        F.count_if(F.col("term").isNull()).alias("n_authors"),
    )
    authors = cut_lineage(
        counted.groupBy("intent", "author").agg(F.sum("tf").alias("total")).join(intents, "intent").select(
            "intent", "author", "total", "intent_total", "n_terms",
            F.ceil(F.greatest("n_terms", F.lit(1)) / BLOCK_TERMS).alias("blocks"), F.ceil(F.col("n_authors") / STRIPE).alias("stripes"),
        )
    )
    shares = salted_join(kept.select("intent", "author", "term", "tf", "all_tf"), authors, ["intent", "author"], ["term"]).select(
        "intent", "author", "term", "blocks", "stripes",
        _share(F.col("tf"), F.col("total"), F.col("n_terms"), smoothing).alias("share"),
        _share(F.col("all_tf"), F.col("intent_total"), F.col("n_terms"), smoothing).alias("intent_share"),
    )
    shares = cut_lineage(shares)

    used = shares.select("intent", "author", "term", "share", "stripes", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    unused = authors.select(
        "intent", "author", F.lit(None).cast("binary").alias("term"),
        _share(F.lit(0), F.col("total"), F.col("n_terms"), smoothing).alias("share"), "stripes",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
    )
    dealt = used.unionByName(unused).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("stripes") - 1)))
    apart = (
        dealt.withColumn("mine", _stripe(F.col("author"), F.col("stripes")) == F.col("stripe"))
        .groupBy("intent", "block", "stripe").applyInArrow(_compare_block, APART)
        .groupBy("intent", "author", "other").agg(F.sum("apart").alias("value"))
        .select("intent", "author", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    )
    strong = shares.filter("share > intent_share").select(
        "intent", "author", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        (F.col("share") - F.col("intent_share")).alias("value"),
    )
    by_value = [F.desc("value"), F.col("item")]
    ranked = top_per_key(strong, ["intent", "author"], by_value, most_terms, "rank").unionByName(
        apart.withColumn("rank", F.row_number().over(Window.partitionBy("intent", "author").orderBy(*by_value)))
    )
    return ranked.select(F.col("intent").alias(intent_column), F.col("author").alias(author_column), "part", "item", "value", "rank")
