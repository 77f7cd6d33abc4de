"""Ranked search of a whole table of questions over past customer messages, each distinct bag of words scored once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.llm.byte_terms import LETTERS_AND_DIGITS, terms_of
from threadweave.operators.common import top_per_key
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

# Fixed values of the score.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75
# Questions are asked in blocks of at most so many terms and questions, so what goes out to the tasks is bounded.
BLOCK_TERMS, BLOCK_QUESTIONS = 32_768, 512
CELLS = 1 << 22  # of a table of bags by terms, scored at a time
EXACT = 1 << 53  # whole numbers below are exact in doubles, whatever the order they are added in
BAG = "struct<n_terms:bigint,bag:binary>"


@dataclass
class QuestionBlock:
    """Questions with their terms as numbers: ``terms[q]`` and ``repeats[q]`` of question ``q``."""

    names: list
    places: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def question_blocks(questions: DataFrame, query_id: str, text: str) -> Iterator[QuestionBlock]:
    """The questions that have terms, block by block; the driver holds one block at a time."""

    def new() -> QuestionBlock:
        return QuestionBlock([], {}, [], [])

    block, held = new(), 0
    rows = questions.select(F.col(query_id).alias("name"), F.col(text).cast("string").cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        counts = Counter(terms_of(row["text"], LETTERS_AND_DIGITS))
        if not counts:
            continue
        if block.names and (held + len(counts) > BLOCK_TERMS or len(block.names) == BLOCK_QUESTIONS):
            yield block
            block, held = new(), 0
        held += len(counts)
        block.names.append(row["name"])
        block.terms.append(np.array([block.places.setdefault(t, len(block.places)) for t in counts], np.int64))
        block.repeats.append(np.array(list(counts.values()), np.int64))
    if block.names:
        yield block


def _with_bags(posts: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """Posts with their number of terms and their bag: sorted term numbers, then occurrences, as 32-bit numbers."""
    shared = posts.sparkSession.sparkContext.broadcast(places)

    @F.arrow_udf(BAG)
    def bags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            sizes, out = [], []
            for text in batch.to_pylist():
                words = terms_of(text, LETTERS_AND_DIGITS)
                sizes.append(len(words))
                found = sorted((known[t], n) for t, n in Counter(words).items() if t in known)
                out.append(np.array(found, "<u4").T.tobytes())
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["n_terms", "bag"])

    return posts.withColumn("counted", bags("text")).select("id", "counted.*")


def _unpack(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and occurrences of every entry of the bags."""
    sizes = np.array([len(b) // 8 for b in bags], np.int64)
    flat = np.frombuffer(b"".join(bags), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(bags)), sizes)
    starts = np.cumsum(sizes) - sizes  # of a bag's entries
    at = np.arange(len(row)) + np.repeat(starts, sizes)
    return row, flat[at], flat[at + np.repeat(sizes, sizes)]


def _document_frequencies(bags: DataFrame, n_places: int) -> dict[int, int]:
    """In how many posts each term of the questions occurs: one number per term of a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_places, np.int64)
        for batch in batches:
            total += np.bincount(_unpack(batch.column(0).to_pylist())[1], minlength=n_places)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["term", "df"])

    rows = bags.select("bag").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r["term"]: r["df"] for r in rows}


def term_weight(n_posts: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_posts + 2) / (2 * df + 1)))


def _length_norm(n: Column, n_posts: int, n_all: int) -> Column:
    wide = F.lit(LENGTH_SHARE * n_posts).cast("decimal(38,0)")
    grown = F.call_function("div", (n.cast("decimal(18,0)") * wide.cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(n_all).cast("decimal(38,0)"))
    return F.lit(100 - LENGTH_SHARE) + grown


class _Scorer:
    """Scores of bags for all questions of a block: a table of bags by terms times one of terms by questions."""

    def __init__(self, block: QuestionBlock, weights: np.ndarray):
        self.asked = np.zeros((len(block.places), len(block.names)), np.int64)
        for q, (terms, repeats) in enumerate(zip(block.terms, block.repeats)):
            self.asked[terms, q] = weights[terms] * repeats
        most = int(self.asked.sum(axis=0).max(initial=0)) * (SCALE // 1000)
        self.kind = np.float64 if most < EXACT else np.int64
        self.asked = self.asked.astype(self.kind)
        self.step = max(1, CELLS // max(1, len(block.places)))

    def scores(self, bags: list[bytes], norms: np.ndarray) -> np.ndarray:
        row, term, tf = _unpack(bags)
        table = np.zeros((len(bags), len(self.asked)), self.kind)
        table[row, term] = SCALE * tf // (1000 * tf + SATURATION * norms[row])
        return (table @ self.asked).astype(np.int64)


def _best_of_task(block: QuestionBlock, weights: np.ndarray, k: int, spark: SparkSession):
    shared = spark.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of bags in the order of their first ids, the k best of each question."""
        block, weights = shared.value
        scorer = _Scorer(block, weights)
        best: list[list] = [[] for _ in block.names]  # (-score, place), place by order of first id
        floor = np.zeros(len(block.names), np.int64)  # a score must be above it to enter
        kept: dict[int, tuple] = {}
        place = 0
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for low in range(0, len(batch), scorer.step):
                part = {name: column.slice(low, scorer.step) for name, column in columns.items()}
                bags = part["bag"].to_pylist()
                scores = scorer.scores(bags, part["norm"].to_numpy(zero_copy_only=False))
                for q in np.flatnonzero((scores > floor).any(axis=0)):
                    column = scores[:, q]
                    fresh = np.flatnonzero(column > floor[q])
                    fresh = fresh[np.argsort(-column[fresh], kind="stable")[:k]]
                    best[q] = sorted([*best[q], *((-int(column[i]), place + int(i)) for i in fresh)])[:k]
                    kept.update((place + int(i), (bags[i], part["norm"][int(i)].as_py(), part["hash"][int(i)].as_py(), part["id"][int(i)])) for i in fresh)
                    if len(best[q]) == k:
                        floor[q] = -best[q][-1][0]
                place += len(bags)
            standing = {p for own in best for _, p in own}
            kept = {p: v for p, v in kept.items() if p in standing}
        out = [(q, -score, *kept[p]) for q, own in enumerate(best) for score, p in own]
        if out:
            q, score, bag, norm, key, name = zip(*out)
            yield pa.RecordBatch.from_arrays([
                pa.array(q, pa.int64()), pa.array(score, pa.int64()), pa.array(bag, pa.binary()), pa.array(norm, pa.int64()),
                pa.array(key, pa.int64()), pa.array([n.as_py() for n in name], name[0].type),
            ], ["question", "score", "bag", "norm", "hash", "id"])

    return run


def _search_block(posts: DataFrame, block: QuestionBlock, k: int, names: DataFrame) -> DataFrame:
    spark = posts.sparkSession
    bags = cut_lineage(_with_bags(posts, block.places))
    n_posts, n_all = bags.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    frequency = _document_frequencies(bags, len(block.places))
    weights = np.array([term_weight(n_posts, frequency.get(t, 0)) for t in range(len(block.places))], np.int64)

    id_last = F.col("id").asc_nulls_last()
    bag_rows = bags.filter(F.length("bag") > 0).select("id", "bag", _length_norm(F.col("n_terms"), n_posts, max(n_all, 1)).alias("norm"))
    bag_rows = bag_rows.withColumn("hash", F.xxhash64("bag", "norm"))
    # Rows meet by the hash and are told apart by the whole bag; a bag of a third of all posts is one row per task.
    classes = bag_rows.groupBy("hash", "bag", "norm").agg(F.min("id").alias("id"))
    id_type = posts.schema["id"].dataType.simpleString()
    scored = classes.sortWithinPartitions(id_last).mapInArrow(
        _best_of_task(block, weights, k, spark), f"question bigint, score bigint, bag binary, norm bigint, hash bigint, id {id_type}"
    )
    best = cut_lineage(top_per_key(scored, ["question"], [F.desc("score"), id_last], k).drop("_rank", "id"))

    # The k smallest ids of a bag are all that can be among the k best of a question. There are at most
    # k hashes per question of a block, so they are broadcast: rows shrink to k per bag before any shuffle.
    wanted = F.broadcast(best.select("hash").distinct())
    members = top_per_key(bag_rows.join(wanted, "hash", "left_semi"), ["hash", "bag", "norm"], [id_last], k)
    found = best.join(members.drop("_rank"), ["hash", "bag", "norm"])
    ranked = top_per_key(found, ["question"], [F.desc("score"), id_last], k, "rank")
    return ranked.join(names, "question").select("name", "rank", "id", "score")


def search_messages(
    queries: DataFrame, pairs: DataFrame, k: int = 10, query_id: str = "query_id", text: str = "text",
    id_column: str = "customer_tweet_id", text_column: str = "customer_text",
) -> DataFrame:
    """The k past customer messages that score highest for each query: ``query_id, rank, customer_tweet_id, score``.

    ``queries`` are messages to answer, ``pairs`` are support pairs (``customer_tweet_id``, ``customer_text``); columns of
    the result are named as the given ones. Terms are runs of letters and digits (any character beyond ASCII counts as
    one), A-Z lower-cased, of whole texts. Scores are whole numbers: a query's term, repeats included, adds its
    weight floor(1000 ln((2N+2)/(2df+1))) times a saturated frequency that falls with the message's length. Only
    scores above 0 are returned; equal scores go by ascending id, null ids last; ranks are unique.

    Messages are reduced to the bag of words that queries ask for. Equal bags of equal length norm are one class, met by
    hash and told apart by the whole bag; a class is scored once and then expanded to its members by ascending id.
    A task keeps the k best classes of each query. Queries are taken in blocks of bounded size, each of which goes
    out to the tasks and reads the messages once.

    Null or empty text, or one without terms: a query finds nothing, a message is not counted and never found.
    Repeated rows are messages of their own, each counted and found; so are repeated queries. Null ids are kept. Empty
    tables give no rows. Other columns are not read.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    require_columns(queries, [query_id, text], "queries")
    require_columns(pairs, [id_column, text_column], "support pairs")
    spark = pairs.sparkSession
    posts = pairs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    name_type, id_type = queries.schema[query_id].dataType.simpleString(), posts.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"name {name_type}, rank int, id {id_type}, score bigint")
    for block in question_blocks(queries, query_id, text):
        names = spark.createDataFrame(list(enumerate(block.names)), f"question bigint, name {name_type}")
        out = out.unionByName(_search_block(posts, block, k, names))
    return out.select(F.col("name").alias(query_id), "rank", F.col("id").alias(id_column), "score")
