"""Near-duplicate posts by word shingles: min-hash bands give candidates, exact Jaccard similarity links them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm.components import connected_components
from threadweave.llm.pretokens import slices
from threadweave.llm.salting import salted_join
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

SEED = 42
HUBS = 3  # rounds in which a bucket's members meet one of them only
TILE = 256
MISSED = 1e-5  # chance at most that a sketch rules out a pair at the similarity asked for


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # on bytes: only A-Z and the six ASCII white-space characters


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 of every run of ``shingle`` words; of the whole sequence if shorter."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[low: high - 1], SEED) for low, high in zip(starts, starts[shingle:])]


def text_digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words), SEED)


def band_codes(hashed: list[list[int]], bands: int, rows: int) -> tuple[list[list[int] | None], list[list[int] | None]]:
    """``bands`` numbers per text, each made of the minima of ``rows`` random orders of its shingles, and a sketch:
    one bit of each minimum, in 64-bit words.

    Two texts agree in one of the numbers with probability 1 - (1 - J^rows)^bands, J their Jaccard similarity; a
    bit of their sketches differs with probability (1 - J) / 2.
    """
    sizes = np.fromiter(map(len, hashed), np.int64, len(hashed))
    owners = np.flatnonzero(sizes)
    out: list[list[int] | None] = [None] * len(hashed)
    bits: list[list[int] | None] = [None] * len(hashed)
    if not len(owners):
        return out, bits
    flat = np.fromiter(itertools.chain.from_iterable(hashed), np.uint64, int(sizes.sum()))
    starts = np.concatenate(([0], np.cumsum(sizes[owners])[:-1]))
    random = np.random.default_rng(SEED).integers(0, 1 << 64, (bands, rows + 1, 2), dtype=np.uint64)
    codes = np.empty((len(owners), bands), np.uint64)
    sketch = np.zeros((len(owners), sketch_words(bands, rows)), np.uint64)
    for band in range(bands):
        code = np.full(len(owners), random[band, rows, 0])
        odd = random[band, rows, 1] | np.uint64(1)
        for row, (flip, factor) in enumerate(random[band, :rows]):
            least = np.minimum.reduceat((flat ^ flip) * (factor | np.uint64(1)), starts)
            code = (code ^ least) * odd
            code ^= code >> np.uint64(29)
            word, bit = divmod(band * rows + row, 64)
            sketch[:, word] |= ((least * odd) >> np.uint64(63)) << np.uint64(bit)
        codes[:, band] = code
    for at, code, words in zip(owners.tolist(), codes.view(np.int64).tolist(), sketch.view(np.int64).tolist()):
        out[at], bits[at] = code, words
    return out, bits


def sketch_words(bands: int, rows: int) -> int:
    return -(-bands * rows // 64)


def sketch_radius(similarity: float, bits: int, missed: float = MISSED) -> int:
    """The number of differing bits that a pair at ``similarity`` exceeds with probability ``missed`` at most."""
    differ = (1 - similarity) / 2
    radius, beyond = -1, 1.0
    while beyond > missed:
        radius += 1
        beyond -= math.comb(bits, radius) * differ ** radius * (1 - differ) ** (bits - radius)
    return radius


def _near_sketches(a: str, b: str, words: int, radius: int) -> Column:
    differing = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(words)]
    return sum(differing[1:], differing[0]) <= radius


def jaccard(a: frozenset[int], b: frozenset[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _marked(posts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``post, digest, codes, sketch`` of every row."""
    kind = posts.schema["post"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, codes, sketches = [], [], []
            for part in slices(batch.column(1)):
                words = [words_of(t or "") for t in part.to_pylist()]
                digests += map(text_digest, words)
                found, bits = band_codes([shingle_hashes(w, shingle) for w in words], bands, rows)
                codes += found
                sketches += bits
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), *[pa.array(x, pa.list_(pa.int64())) for x in (codes, sketches)]],
                ["post", "digest", "codes", "sketch"],
            )

    return posts.mapInArrow(run, f"post {kind}, digest binary, codes array<bigint>, sketch array<bigint>")


def _texts(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, text``: one text for each of the distinct texts ``key, digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                digests = [text_digest(words_of(t or "")) for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part], ["digest", "text"])

    return posts.select("text").mapInArrow(run, "digest binary, text string").join(keys, "digest").dropDuplicates(["key"]).select("key", "text")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs ``a, b`` whose shingle sets are at least as similar as ``similarity``."""
    full = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("right")), "b"
    ).select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, frozenset()
        for batch in batches:
            near = []
            for row in range(batch.num_rows):
                b = batch.column(1)[row].as_py()
                if b != key:
                    key, last = b, frozenset(shingle_hashes(words_of(batch.column(3)[row].as_py() or ""), shingle))
                other = frozenset(shingle_hashes(words_of(batch.column(2)[row].as_py() or ""), shingle))
                near.append(jaccard(last, other) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return full.mapInArrow(run, "a bigint, b bigint")


def _pairs_of_hubs(members: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Each open bucket's members against one of them, and the members that have not been a hub."""
    hub = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key", "component")).alias("hub")
    buckets = members.groupBy("bucket").agg(hub, F.min("component").alias("low"), F.max("component").alias("high"))
    found = salted_join(members, buckets.filter("low < high"), ["bucket"], ["key"]).filter("key <> hub.key")
    met = found.filter("component <> hub.component").select(F.col("key").alias("a"), F.col("hub.key").alias("b"))
    return met, found.select("bucket", "key")


def _alike(pairs: DataFrame, sketches: DataFrame, words: int, radius: int) -> DataFrame:
    """Those pairs ``a, b`` whose sketches differ in ``radius`` bits at most."""
    of_a = sketches.select(F.col("key").alias("a"), F.col("sketch").alias("left"))
    of_b = sketches.select(F.col("key").alias("b"), F.col("sketch").alias("right"))
    return pairs.join(of_a, "a").join(of_b, "b").filter(_near_sketches("left", "right", words, radius)).select("a", "b")


def _pairs_apart(members: DataFrame, sketches: DataFrame, words: int, radius: int) -> DataFrame:
    """Pairs of a bucket's members whose components differ and whose sketches are near, dealt out by tiles of members.

    Sketches are compared while the members meet: pairs that a shared passage brought into one bucket are
    not written, and no text is read for them.
    """
    tiles = members.groupBy("bucket").agg(
        F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high")
    dealt = salted_join(members, tiles, ["bucket"], ["key"]).join(sketches, "key")
    left = dealt.select("bucket", F.col("key").alias("a"), F.col("component").alias("of_a"), F.col("sketch").alias("left"), F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)).alias("tile"))
    right = dealt.select(
        "bucket", F.col("key").alias("b"), F.col("component").alias("of_b"), F.col("sketch").alias("right"), F.pmod(F.xxhash64("key"), "tiles").cast("int").alias("tile")
    )
    return left.join(right, ["bucket", "tile"]).filter(F.expr("a < b and of_a <> of_b") & _near_sketches("left", "right", words, radius)).select("a", "b")


def near_duplicate_texts(
    posts: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 20, rows: int = 4,
    id_column: str = "tweet_id", text_column: str = "text",
) -> DataFrame:
    """The id of each post and its ``component_id``, the smallest id reachable by links.

    Two posts are linked if the sets of their ``shingle``-word runs (ASCII letters lower-cased, whole text) have a
    Jaccard similarity of ``similarity`` or more. Candidates are texts that agree in one of ``bands`` min-hash
    bands and whose min-hash sketches (one bit of each minimum) are near: with the defaults a pair at 0.8 is missed with
    probability 0.00004, a pair at 0.3 passes the sketches in one of 16 cases. Every link is verified on the texts
    themselves, so none is false.

    Equal texts are one from the start. In a bucket, members first meet one hub at a time, so a large
    group of near copies is held together by one link a member; only members that ``HUBS`` hubs leave in different
    components are compared with each other, by their sketches in tiles: the part that grows with the square of such
    a bucket. Only pairs whose sketches are near are written and verified.

    Null and empty texts are equal. Null ids: the row stays; ``component_id`` is null if no linked post
    has an id. Repeated rows stay. Other columns are not read. An empty table gives an empty result.
    """
    require_columns(posts, [id_column, text_column], "posts")
    posts = posts.select(F.col(id_column).alias("post"), F.col(text_column).cast("string").alias("text"))
    marked = cut_lineage(_marked(posts, shingle, bands, rows))
    distinct = cut_lineage(
        marked.groupBy("digest").agg(F.min("post").alias("smallest"), F.first("codes").alias("codes"), F.first("sketch").alias("sketch"))
        .withColumn("key", F.monotonically_increasing_id())
    )
    placed = distinct.select(F.explode("codes").alias("bucket"), "key")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = cut_lineage(salted_join(placed, shared, ["bucket"], ["key"]))
    keys = buckets.select("key").distinct().join(distinct.select("key", "digest"), "key")
    texts = cut_lineage(_texts(posts, keys))
    words, radius = sketch_words(bands, rows), sketch_radius(similarity, bands * rows)
    sketches = cut_lineage(distinct.select("key", "sketch").join(keys.select("key"), "key", "left_semi"))
    links, groups = None, None
    for turn in range(HUBS + 1):
        members = buckets if groups is None else buckets.join(groups, "key", "left")
        component = F.col("key") if groups is None else F.coalesce("component", "key")
        members = cut_lineage(members.select("bucket", "key", component.alias("component")))
        if turn < HUBS:
            pairs, buckets = _pairs_of_hubs(members, turn)
            buckets = cut_lineage(buckets)
        else:
            pairs = _pairs_apart(members, sketches, words, radius)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut_lineage(_alike(pairs, sketches, words, radius) if turn < HUBS else pairs)
        if not pairs.isEmpty():
            found = cut_lineage(_verified(pairs, texts, shingle, similarity))
            links = found if links is None else links.unionByName(found)
            groups = cut_lineage(connected_components(links, "a", "b").select(F.col("node").alias("key"), "component"))
    named = distinct.select("digest", "smallest", F.col("key").alias("component") if groups is None else "key")
    if groups is not None:
        named = named.join(groups, "key", "left").select("digest", "smallest", F.coalesce("component", "key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    by_digest = salted_join(named, lowest, ["component"], ["digest"]).select("digest", "component_id")
    return salted_join(marked.select("post", "digest"), by_digest, ["digest"], ["post"]).select(F.col("post").alias(id_column), "component_id")
