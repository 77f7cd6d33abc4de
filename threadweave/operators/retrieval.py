"""Lexical retrieval: cosine over TF-IDF for a whole table of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import nsmallest
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions.normalize import has_text
from threadweave.operators.common import top_per_key
from threadweave.operators.tfidf import hashed_frequencies, unit_weights, with_hashed_terms
from threadweave.operators.weak_training import exclude_ids
from threadweave.schema import require_columns
from threadweave.session import cut_lineage, import_on_workers
from threadweave.sources.tables import spread

# Bounds compare sums taken in different orders; this covers their rounding.
SLACK = 1e-9
DIGITS = 12  # scores that agree in so many are equal, and go by id
LEVELS = 16  # of how common a term is, each for half as many documents as the one before
FIRST = 256  # documents that all questions of a task meet first, to know what a score must reach
# What the common terms may add to a score, as a share of what it must reach, in all but one in so many documents.
SPARED, APART = 1.0, 100
# Questions are asked in portions of at most so many of them and of their terms, so what goes to the tasks is bounded.
PORTION, PORTION_TERMS = 16_384, 1 << 21
PORTIONS = 2  # asked in one job, after which what was sent out for them is dropped
TASKS_A_CORE = 1  # that read the vectors: the more a task has seen, the less it scores
BROADCAST_TERMS = 1_000_000  # of questions, by which the vocabulary is cut before it is shuffled
BLOCK_CHARS = 1 << 22  # of the texts whose terms are told together
PART_CHARS = 1 << 24  # of the texts whose terms share a range of hashes, if dealt evenly
TERMS_HELD = 1 << 21  # distinct terms of texts a task holds, one batch apart
ROWS_OF_TASK = (1 << 33) - 1  # the bits of a row's number that count inside its task
CELLS = 1 << 21  # weights of the documents that are searched at a time, a document apart
NUMBERS = 1 << 25  # terms numbered up to this are found by a table
SEPARATOR = "\x1f"  # between the ids of a pair


@dataclass
class RetrievalIndex:
    """``docs``: one row per pair; ``vocab``: term, number, df, idf; ``vectors``: the terms of a pair by their numbers,
    their counts, and the length (``size``) by which counts times idf are divided.

    A term is the 64-bit hash of a word or word pair. The vectors of a block lie in the order of their length.
    """

    docs: DataFrame
    vocab: DataFrame
    vectors: DataFrame
    meta: DataFrame

    TABLES = {
        "docs": FV.RETRIEVAL_COLUMNS,
        "vocab": ["term", "number", "df", "idf"],
        "vectors": ["doc_id", "size", "terms", "tfs"],
        "meta": ["n_documents", "n_features", "method", "max_ngram", "min_df", "excluded_golden"],
    }


def pairs_for_retrieval(pairs: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """R1/S5. The four columns, nulls as empty, without blank messages and reserved ids."""
    require_columns(pairs, FV.RETRIEVAL_COLUMNS, "support pairs")
    kept = pairs.select(
        "customer_tweet_id", "agent_tweet_id",
        F.coalesce("customer_text", F.lit("")).alias("customer_text"),
        F.coalesce("agent_text", F.lit("")).alias("agent_text"),
    ).filter(has_text("customer_text"))
    return exclude_ids(kept, reserved) if reserved is not None else kept


def _doc_id() -> Column:
    """Ranking key: customer id first, then agent id (a customer may have several replies)."""
    return F.concat_ws(SEPARATOR, "customer_tweet_id", "agent_tweet_id")


def build_index(
    pairs: DataFrame, reserved: DataFrame | None = None, min_df: int = FV.TFIDF_MIN_DF
) -> RetrievalIndex:
    """R2. Index tables of a pair table.

    Terms are counted in blocks of texts: a block sends each of its terms once to the range of hashes it lies in, and gets
    back its number and how many documents have it. The texts are read a second time to meet that; their own
    terms and weights are never shuffled.
    """
    rows = pairs_for_retrieval(pairs, reserved).withColumn("doc_id", _doc_id())
    # The numbers of the rows of one task follow each other.
    numbered = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "zstd")
    n_documents, n_chars = numbered.agg(F.count(F.lit(1)), F.sum(F.length("customer_text"))).first()
    if not n_documents:
        raise ValueError("no support pairs left to index")
    block, parts = block_of(numbered, n_documents, n_chars)
    texts = numbered.select(block.alias("block"), "row", "doc_id", "customer_text")
    known = cut_lineage(_known_terms(texts, parts, min_df), "zstd")
    vocab = known.filter("block IS NULL").select("part", F.posexplode(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))).alias("rank", "t")).select(
        "t.term", (F.col("rank") * parts + F.col("part")).alias("number"), F.col("t.df").alias("df"), _idf(F.col("t.df"), n_documents).alias("idf")
    )
    vectors = _of_distinct_ids(cut_lineage(_vectors(texts, known.filter("block IS NOT NULL"), parts, n_documents), "zstd"))
    meta = vocab.agg(F.count(F.lit(1)).alias("n_features")).select(
        F.lit(n_documents).cast("bigint").alias("n_documents"), "n_features",
        F.lit("tfidf_cosine").alias("method"), F.lit(FV.TFIDF_MAX_N).alias("max_ngram"),
        F.lit(min_df).alias("min_df"), F.lit(reserved is not None).alias("excluded_golden"),
    )
    return RetrievalIndex(numbered.drop("row"), vocab, vectors, meta)


def block_of(numbered: DataFrame, n_documents: int, n_chars: int) -> tuple[Column, int]:
    """The block a numbered row is in, and the number of ranges of hashes."""
    cores = import_on_workers(numbered.sparkSession).sparkContext.defaultParallelism
    block_chars = min(BLOCK_CHARS, max(1, n_chars // (2 * cores)))
    block = F.col("row") - F.col("row").bitwiseAND(F.lit(ROWS_OF_TASK)) % max(1, n_documents * block_chars // n_chars)
    return block, max(cores, -(-n_chars // PART_CHARS))


def _idf(df: Column, n_documents: int) -> Column:
    return F.log(F.lit(1.0 + n_documents) / (F.lit(1.0) + df)) + 1.0


def _packed(numbers: np.ndarray, kind: str = "<u8") -> bytes:
    """Numbers with their first bytes together, then their second bytes and so on: small ones are mostly runs of zeros."""
    return numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _unpacked(data: bytes, kind: str = "<u8") -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _term_runs(terms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text in a row, their counts, and how many a text has."""
    found = [np.unique(terms[low:high], return_counts=True) for low, high in zip(ends[:-1], ends[1:])]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int32), np.array([len(f[0]) for f in found])


def _own_terms(parts: int):
    """One row per portion of a block and range of hashes: the portion's terms there, in order, with their documents.

    A portion is a block, or what a task has of it; its rows follow each other.
    """

    def told(block: int, first: int, held: list[np.ndarray]) -> pa.RecordBatch:
        terms, df = np.unique(np.concatenate(held), return_counts=True)
        ends = np.searchsorted((terms >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        used = np.flatnonzero(np.diff(ends))
        slices = [slice(ends[p], ends[p + 1]) for p in used]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array([first] * len(used), pa.int64()),
                pa.array([_packed(np.diff(terms[s], prepend=np.uint64(0))) for s in slices], pa.binary()),
                pa.array([_packed(df[s], "<u4") for s in slices], pa.binary()),
            ],
            ["part", "block", "first", "steps", "dfs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first = last = None
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, rows = (batch.column(name).to_numpy() for name in ("block", "row"))
            terms = batch.column("terms")
            values, ends = terms.values.to_numpy().view(np.uint64), terms.offsets.to_numpy()
            begins = np.flatnonzero((blocks[1:] != blocks[:-1]) | (rows[1:] != rows[:-1] + 1)) + 1
            for low, high in zip([0, *begins], [*begins, len(rows)]):
                if held and (blocks[low] != block or rows[low] != last + 1 or size > TERMS_HELD):
                    yield told(block, first, held)
                    held, size = [], 0
                if not held:
                    block, first = int(blocks[low]), int(rows[low])
                last = rows[high - 1]
                held.append(_term_runs(values, ends[low: high + 1])[0])
                size += len(held[-1])
        if held:
            yield told(block, first, held)

    return run


def _known_terms(texts: DataFrame, parts: int, min_df: int) -> DataFrame:
    """The vocabulary, one row a range of hashes (``block`` is null), and for every portion of texts the rank and number
    of documents of its terms, in their order; 0 where too few documents have a term."""
    own = with_hashed_terms(texts.select("block", "row", "customer_text"), "customer_text").select("block", "row", "terms")
    sent = own.mapInArrow(_own_terms(parts), "part int, block bigint, first bigint, steps binary, dfs binary")

    def run(table: pa.Table) -> pa.Table:
        terms = [np.cumsum(_unpacked(steps), dtype=np.uint64) for steps in table["steps"].to_pylist()]
        own = np.concatenate([_unpacked(dfs, "<u4") for dfs in table["dfs"].to_pylist()]).astype(np.int64)
        every, place = np.unique(np.concatenate(terms), return_inverse=True)
        df = np.bincount(place, own, len(every)).astype(np.int64)
        kept = df >= min_df
        rank = np.where(kept, np.cumsum(kept) - 1, 0)[place]
        answer, ends = np.where(kept, df, 0)[place], np.cumsum([0, *map(len, terms)])
        slices = [slice(low, high) for low, high in zip(ends[:-1], ends[1:])]
        # Ranks only grow, those of unknown terms apart, which take the one before.
        grown = [np.maximum.accumulate(rank[s]) for s in slices]
        part, n = table["part"][0].as_py(), len(slices)
        return pa.table(
            {
                "part": pa.array([part] * (n + 1), pa.int32()),
                "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
                "first": pa.array([*table["first"].to_pylist(), None], pa.int64()),
                "steps": pa.array([*(_packed(np.diff(g, prepend=0)) for g in grown), None], pa.binary()),
                "found": pa.array([*(_packed(answer[s], "<u4") for s in slices), None], pa.binary()),
                "terms": pa.array([*[None] * n, every[kept].view(np.int64)], pa.list_(pa.int64())),
                "dfs": pa.array([*[None] * n, df[kept]], pa.list_(pa.int64())),
            }
        )

    found = sent.groupBy("part").applyInArrow(
        run, "part int, block bigint, first bigint, steps binary, found binary, terms array<bigint>, dfs array<bigint>"
    )
    return found


def _weighted(parts: int, n_documents: int):
    """Vectors of a portion's texts, in the order of their length, from what is known of its terms."""

    def told(known: list[tuple[int, bytes, bytes]], ids: list[str], held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        terms, tf, each = (np.concatenate(x) for x in zip(*held))
        every, place = np.unique(terms, return_inverse=True)
        answers = [(np.cumsum(_unpacked(steps)).astype(np.int64) * parts + part, _unpacked(found, "<u4")) for part, steps, found in sorted(known)]
        number, df = (np.concatenate(x) for x in zip(*answers)) if answers else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        if len(number) != len(every):
            raise ValueError(f"{len(every)} terms in a portion of texts, {len(number)} of them told")
        kept = df[place] > 0
        doc, place, tf = np.repeat(np.arange(len(ids)), each)[kept], place[kept], tf[kept]
        raw = tf * (np.log((1.0 + n_documents) / (1.0 + df[place])) + 1.0)
        size = np.sqrt(np.bincount(doc, raw * raw, len(ids)))
        each = np.bincount(doc, minlength=len(ids))
        begins = np.cumsum(each) - each
        order = np.argsort(size, kind="stable")
        order = order[each[order] > 0]
        at = np.repeat(begins[order] - (np.cumsum(each[order]) - each[order]), each[order]) + np.arange(each[order].sum())
        offsets = pa.array(np.concatenate(([0], np.cumsum(each[order]))), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.string()).take(pa.array(order)), pa.array(size[order], pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(number[place[at]], pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(tf[at], pa.int32())),
            ],
            ["doc_id", "size", "terms", "tfs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, held = [], [], []
        for batch in batches:
            part = batch.column("part")
            told_of = np.asarray(part.is_valid())
            terms, names = batch.column("terms"), batch.column("doc_id")
            values, ends = terms.values.to_numpy().view(np.uint64), terms.offsets.to_numpy()
            begins = np.flatnonzero(told_of[1:] != told_of[:-1]) + 1
            for low, high in zip([0, *begins], [*begins, batch.num_rows]):
                if low == high:
                    continue
                if told_of[low]:
                    if held:
                        yield told(known, ids, held)
                        known, ids, held = [], [], []
                    known += zip(*(batch.column(name).slice(low, high - low).to_pylist() for name in ("part", "steps", "found")))
                else:
                    ids += names.slice(low, high - low).to_pylist()
                    held.append(_term_runs(values, ends[low: high + 1]))
        if held:
            yield told(known, ids, held)

    return run


def _vectors(texts: DataFrame, known: DataFrame, parts: int, n_documents: int) -> DataFrame:
    """Texts meet what is known of their terms, which comes before the first row of the portion it was told for."""
    answers = known.select(
        "block", F.col("first").alias("row"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("doc_id"),
        F.lit(None).cast("string").alias("customer_text"), "part", "steps", "found",
    )
    asking = texts.select(
        "block", "row", F.lit(1).alias("kind"), "doc_id", "customer_text",
        F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("steps"), F.lit(None).cast("binary").alias("found"),
    )
    together = answers.unionByName(asking).repartition("block").sortWithinPartitions("block", "row", "kind")
    read = with_hashed_terms(together, "customer_text").select("doc_id", "terms", "part", "steps", "found")
    return read.mapInArrow(_weighted(parts, n_documents), "doc_id string, size double, terms array<bigint>, tfs array<int>")


def _of_distinct_ids(vectors: DataFrame) -> DataFrame:
    """Texts of one id are one vector; only they are shuffled, if there are any."""
    shared = cut_lineage(vectors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if shared.isEmpty():
        return vectors
    added = vectors.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.sqrt(F.sum(F.col("size") * F.col("size"))).alias("size"), F.collect_list(F.struct("terms", "tfs")).alias("e")
    ).select("doc_id", "size", F.flatten("e.terms").alias("terms"), F.flatten("e.tfs").alias("tfs"))
    return cut_lineage(vectors.join(shared, "doc_id", "left_anti").unionByName(added), "zstd")


def save_index(index: RetrievalIndex, path: str) -> None:
    """S10. The vectors of a block stay in the order of their length."""
    for name in RetrievalIndex.TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> RetrievalIndex:
    """R2b. The saved tables, checked for their columns."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in RetrievalIndex.TABLES}
    for name, columns in RetrievalIndex.TABLES.items():
        require_columns(tables[name], columns, f"retrieval index table {name}")
    docs = tables["docs"]
    if "doc_id" not in docs.columns:
        docs = docs.withColumn("doc_id", _doc_id())
    return RetrievalIndex(docs, tables["vocab"], tables["vectors"], tables["meta"])


class _Portion:
    """Some questions: their names, the message each must not find, the terms they have, and weights by question and term.

    ``weights`` is a table, or the rows, places and weights of what is not zero in it; ``idf`` is that of the terms.
    """

    def __init__(
        self, names: list[str], owns: list[str | None], terms: np.ndarray,
        weights: np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray], idf: np.ndarray | None = None,
    ):
        self.names, self.owns, self.terms, self.idf = names, owns, terms, idf
        at = weights[:2] if isinstance(weights, tuple) else np.nonzero(weights)
        self.row, self.place = (places.astype(np.int32) for places in at)
        self.weight = weights[2] if isinstance(weights, tuple) else weights[at]

    @property
    def weights(self) -> np.ndarray:
        table = np.zeros((len(self.names), len(self.terms)))
        table[self.row, self.place] = self.weight
        return table


def _portions(terms: DataFrame) -> Iterator[_Portion]:
    """Questions with terms of the index, portion by portion; the driver holds one portion at a time."""

    def packed(rows: list[tuple]) -> _Portion:
        names, owns, *lists = zip(*rows)
        numbers, weights, idfs = (np.concatenate(x) for x in lists)
        known, first, place = np.unique(numbers, return_index=True, return_inverse=True)
        row = np.repeat(np.arange(len(rows)), [len(x) for x in lists[0]])
        # The last one counts where a question has a term twice.
        _, last = np.unique((row * len(known) + place)[::-1], return_index=True)
        kept = len(row) - 1 - last
        return _Portion(list(names), list(owns), known, (row[kept], place[kept], weights[kept]), idfs[first])

    rows, held = [], 0
    for row in terms.toLocalIterator():
        if rows and (len(rows) == PORTION or held + len(row["terms"]) > PORTION_TERMS):
            yield packed(rows)
            rows, held = [], 0
        rows.append((row["question"], row["own"], np.array(row["terms"], np.int64), np.array(row["weights"]), np.array(row["idfs"])))
        held += len(row["terms"])
    if rows:
        yield packed(rows)


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Search:
    """The k best documents of each question of a portion among those a task has seen.

    Products of weights are summed for the rarer terms of a question only. What its other terms, the common ones, may add
    to a document's score is at most the product of both lengths in these terms. Documents that could
    reach the k-th best score so far with that, and no others, are scored by all terms.
    """

    def __init__(self, portion: _Portion, k: int):
        self.portion, self.k = portion, k
        self.best: list[list[tuple[float, str]]] = [[] for _ in portion.names]
        self.floor = np.full(len(portion.names), np.finfo(float).tiny)  # what a score must reach
        self.begins = np.searchsorted(portion.row, np.arange(len(portion.names) + 1))
        self.table = None
        if len(portion.terms) and 0 <= portion.terms[0] and portion.terms[-1] < NUMBERS:
            self.table = np.full(portion.terms[-1] + 2, -1, np.int32)
            self.table[portion.terms] = np.arange(len(portion.terms))
        self.asking = np.zeros(len(portion.terms))  # the weights of the question being scored
        self.owned = any(own is not None for own in portion.owns)
        self.n_taken = self.n_scored = 0

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term among those of the portion, -1 where it has none."""
        if self.table is not None:
            return self.table[np.where((terms >= 0) & (terms < len(self.table)), terms, -1)]
        known = self.portion.terms
        place = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        return np.where(known[place] == terms, place, -1)

    def take(self, ids: list[str], sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """More documents: their ids, numbers of terms, and all their terms and weights in a row."""
        place = self.places(terms)
        asked = np.flatnonzero(place >= 0)
        doc = np.repeat(np.arange(len(ids)), sizes)[asked]
        self.add(ids, np.bincount(doc, minlength=len(ids)), place[asked], weights[asked])

    def add(self, ids: list[str], sizes: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
        """As ``take``, of the terms the portion has only, by their places; of a term twice in a document, the last counts."""
        code = np.repeat(np.arange(len(ids)), sizes) * len(self.portion.terms) + place
        if not np.diff(np.sort(code)).all():
            code, last = np.unique(code[::-1], return_index=True)
            doc, place = np.divmod(code, len(self.portion.terms))
            sizes, weight = np.bincount(doc, minlength=len(ids)), weight[::-1][last]
        docs = np.flatnonzero(sizes)
        begins = np.cumsum(sizes) - sizes
        first = np.zeros(0, np.int64) if self.n_taken else docs[:: max(1, len(docs) // FIRST)]
        rest = np.setdiff1d(docs, first, assume_unique=True)
        portion = np.cumsum(sizes[rest]) // CELLS
        self.n_taken += len(docs)
        for some in (first, *np.split(rest, np.flatnonzero(np.diff(portion)) + 1)):
            if len(some):
                at = _runs(begins[some], sizes[some])
                self._chunk([ids[d] for d in some], sizes[some], place[at], weight[at])

    def _chunk(self, ids: list[str], sizes: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
        asked, n = self.portion, len(ids)
        doc = np.repeat(np.arange(n), sizes)
        order = np.argsort(place)
        df = np.bincount(place, minlength=len(asked.terms))
        begins, by_term, weight_by_term = np.cumsum(df) - df, doc[order], weight[order]
        level = np.minimum(np.log2(n / np.maximum(df, 0.5)), LEVELS - 1).astype(np.int64)
        # Lengths in the terms of the first levels, of documents and questions.
        lengths = np.sqrt(np.cumsum(np.bincount(level[place] * n + doc, weight**2, LEVELS * n).reshape(LEVELS, n), axis=0))
        lengths = np.concatenate([np.zeros((1, n)), lengths])
        used = np.flatnonzero(df[asked.place])
        row, place_of, weight_of = asked.row[used], asked.place[used], asked.weight[used]
        own = np.bincount(row * LEVELS + level[place_of], weight_of**2, len(asked.names) * LEVELS).reshape(-1, LEVELS)
        own = np.concatenate([np.zeros((len(own), 1)), np.sqrt(np.cumsum(own, axis=1))], axis=1)
        most = np.sort(lengths, axis=1)[:, -1 - n // APART]
        common = (own * most < SPARED * self.floor[:, None]).sum(axis=1) - 1
        rare = np.flatnonzero(level[place_of] >= common[row])
        row, place_of, weight_of = row[rare], place_of[rare], weight_of[rare]
        reached = np.maximum(self.floor - SLACK, np.finfo(float).tiny)
        added = own[np.arange(len(own)), common]
        first_of = np.searchsorted(row, np.arange(len(asked.names) + 1))
        messages = Counter(i.split(SEPARATOR, 1)[0] for i in ids) if self.owned else {"": 0}
        enough = self.k + max(messages.values())
        begin_of_doc = np.cumsum(sizes) - sizes
        for q, c in enumerate(common.tolist()):
            part = slice(first_of[q], first_of[q + 1])
            each = df[place_of[part]]
            at = _runs(begins[place_of[part]], each)
            sums = np.bincount(by_term[at], np.repeat(weight_of[part], each) * weight_by_term[at], n)
            bounds = sums if added[q] == 0.0 else lengths[c] * added[q] + sums
            found = np.flatnonzero(bounds >= reached[q])
            if len(found) > enough:
                # So many others that are not the question's own reach at least what they have of the rarer terms.
                known = np.partition(sums[found], -enough)[-enough] - SLACK
                found = found[bounds[found] >= known]
            if len(found):
                self._score(q, found, ids, begin_of_doc, sizes, place, weight)

    def _score(
        self, q: int, docs: np.ndarray, ids: list[str], begins: np.ndarray, sizes: np.ndarray, place: np.ndarray, weight: np.ndarray,
    ) -> None:
        """Some documents of a chunk by all terms of a question."""
        self.n_scored += len(docs)
        mine, own = slice(self.begins[q], self.begins[q + 1]), self.portion.owns[q]
        self.asking[self.portion.place[mine]] = self.portion.weight[mine]
        each = sizes[docs]
        at = _runs(begins[docs], each)
        scores = np.round(np.bincount(np.repeat(np.arange(len(docs)), each), self.asking[place[at]] * weight[at], len(docs)), DIGITS)
        self.asking[self.portion.place[mine]] = 0.0
        kept = np.flatnonzero(scores >= self.floor[q])
        found = [(-float(scores[i]), ids[docs[i]]) for i in kept]
        if own is not None:
            found = [x for x in found if x[1].split(SEPARATOR, 1)[0] != own]
        if found:
            best = self.best[q] = nsmallest(self.k, [*self.best[q], *found])
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], -best[-1][0])


def _together(held: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]) -> tuple:
    ids, *arrays = zip(*held)
    return [i for some in ids for i in some], *map(np.concatenate, arrays)


def _best_of_task(shared: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value, k)
        idf, held, size = shared.value.idf, [], 0
        for batch in batches:
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("terms")
            place = search.places(lists.flatten().to_numpy())
            asked = np.flatnonzero(place >= 0)
            doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))[asked]
            place, tfs = place[asked], batch.column("tfs").flatten().to_numpy()[asked]
            weights = tfs * idf[place] / batch.column("size").to_numpy()[doc]
            held.append((ids, np.bincount(doc, minlength=len(ids)), place, weights))
            size += len(place)
            if size >= CELLS:
                search.add(*_together(held))
                held, size = [], 0
        if held:
            search.add(*_together(held))
        rows = [(search.portion.names[q], i, -s) for q, best in enumerate(search.best) for s, i in best]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["question", "doc_id", "score"]
        )

    return run


def _best_of_all(portions: tuple[_Portion, ...], vectors: DataFrame, k: int, spark: SparkSession) -> DataFrame:
    """``question, doc_id, score``: the k best of each question, written before the next portions go out."""
    shared = [spark.sparkContext.broadcast(portion) for portion in portions]
    vectors = vectors.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    parts = [vectors.mapInArrow(_best_of_task(s, k), "question string, doc_id string, score double") for s in shared]
    best = top_per_key(reduce(DataFrame.unionByName, parts), ["question"], [F.desc("score"), F.col("doc_id")], k)
    written = cut_lineage(best.drop("_rank"))
    for s in shared:
        s.destroy()
    return written


def _foreign() -> Column:
    """Whether a document is not of the customer message that asks."""
    return F.col("own").isNull() | ~F.col("doc_id").startswith(F.concat("own", F.lit(SEPARATOR)))


def _filler(docs: DataFrame, k: int) -> Column:
    """The smallest ids, enough for k of them to be of other messages than any one asker's.

    Those are among the first k of each of the first k + 1 messages.
    """
    first = F.broadcast(docs.groupBy("customer_tweet_id").agg(F.count(F.lit(1))).orderBy("customer_tweet_id").limit(k + 1))
    own = docs.select("customer_tweet_id", "doc_id").join(first, "customer_tweet_id", "left_semi")
    some = top_per_key(own, ["customer_tweet_id"], [F.col("doc_id")], k)
    return some.select("doc_id").orderBy("doc_id").limit(2 * k).agg(F.collect_list("doc_id")).scalar()


def retrieve_scores(
    queries: DataFrame, index: RetrievalIndex, k: int = 5, query_id: str = "query_id", text: str = "text",
    own: str | None = None,
) -> DataFrame:
    """R3. ``(query_id, doc_id, score, rank)``: the exact k best documents of every query.

    ``own`` names a column with the customer message a query comes from: its pairs are never found, so
    a message does not retrieve itself. Equal texts (of one message, with ``own``) are one question,
    scored once. Questions go out to the tasks in portions of bounded size, each of which reads the vectors once and
    shuffles k rows per question and task. A task sums up the rarer terms of a question; the lengths of a document and
    the question in the common ones bound what these can add, and documents that cannot reach the k-th best score of
    the question so far are not scored by them; no document is left out of the result by that. Questions
    with fewer than k matches are filled with score 0 in id order.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    named = queries.select(
        F.col(query_id).cast("string").alias("query_id"), F.col(text).alias("text"),
        (F.col(own).cast("string") if own else F.lit(None).cast("string")).alias("own"),
    ).filter(has_text("text"))
    asked = cut_lineage(named.groupBy("text", "own").agg(F.min("query_id").alias("question")))
    frequencies = hashed_frequencies(asked, "question", "text")
    vocab = index.vocab.withColumn("factor", F.col("idf"))
    wanted = cut_lineage(frequencies.select("term").distinct())
    if wanted.count() <= BROADCAST_TERMS:
        vocab = cut_lineage(vocab.join(F.broadcast(wanted), "term", "left_semi"))
    weighted = unit_weights(frequencies, vocab, "question", "number", "factor")
    terms = cut_lineage(
        weighted.groupBy("question").agg(F.collect_list(F.struct("number", "w", "factor")).alias("e"))
        .join(asked.select("question", "own"), "question")
        .select("question", "own", F.col("e.number").alias("terms"), F.col("e.w").alias("weights"), F.col("e.factor").alias("idfs"))
    )
    spark = import_on_workers(queries.sparkSession)
    dealt = spread(index.vectors)
    vectors = index.vectors if dealt is index.vectors else cut_lineage(dealt, "zstd")
    scored = spark.createDataFrame([], "question string, doc_id string, score double")
    for portions in batched(_portions(terms), PORTIONS):
        scored = scored.unionByName(_best_of_all(portions, vectors, k, spark))
    filler = asked.select("question", "own", _filler(index.docs, k).alias("ids")).select(
        "question", "own", F.explode("ids").alias("doc_id"), F.lit(0.0).alias("score")
    ).filter(_foreign()).drop("own")
    complete = (
        scored.unionByName(filler)
        .groupBy("question", "doc_id").agg(F.sum("score").alias("score"))
    )
    best = top_per_key(
        complete, ["question"], [F.round("score", DIGITS).desc(), F.col("doc_id")], k, "rank"
    )
    # Back from questions to the queries that asked them.
    same = (named["text"] == asked["text"]) & named["own"].eqNullSafe(asked["own"])
    askers = named.join(asked, same).select("query_id", "question")
    return askers.join(best, "question").select("query_id", "doc_id", "score", "rank")


def retrieve_similar(
    queries: DataFrame, index: RetrievalIndex, k: int = 5, query_id: str = "query_id", text: str = "text",
    own: str | None = None,
) -> DataFrame:
    """R3/L6. Ranked rows with the texts of the found pairs; ``own`` as in ``retrieve_scores``."""
    scores = retrieve_scores(queries, index, k, query_id, text, own)
    return scores.join(index.docs, "doc_id").select(
        "query_id", "rank", *FV.RETRIEVAL_COLUMNS, F.col("score").alias("similarity_score")
    )


def evidence_arrays(ranked: DataFrame) -> DataFrame:
    """R3. One row per query with its (at most k) rows as an array in rank order."""
    item = F.struct("rank", *FV.RETRIEVAL_COLUMNS, "similarity_score")
    ordered = F.array_sort(F.collect_list(item))
    return ranked.groupBy("query_id").agg(
        F.transform(
            ordered,
            lambda e: F.struct(*[e[c].alias(c) for c in (*FV.RETRIEVAL_COLUMNS, "similarity_score")]),
        ).alias("evidence")
    )
