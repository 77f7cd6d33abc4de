"""SimHash near-duplicates of posts by tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm.components import connected_components, unite
from threadweave.llm.pretokens import slices
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

SHINGLE, SEED, BITS = 3, 42, 64
QUARTERS = 4  # population counts are kept for each 16 bits
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of every run of three words, repeats included; of the whole sequence if shorter."""
    words = text.encode().lower().split()  # on bytes: only A-Z and the six ASCII white-space characters
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[low: high - 1], SEED) for low, high in zip(starts, starts[SHINGLE:])]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A bit is 1 if set in over half of a text's hashes; a text without words has 0.

    All hashes lie in one array. For each of eight shifts, eight bits are counted at once in the bytes
    of a 64-bit number, over runs of at most 255 hashes so that no byte overflows.
    """
    out = np.zeros(len(texts), np.uint64)
    hashed = [shingle_hashes(t) for t in texts]
    sizes = np.fromiter(map(len, hashed), np.int64, len(hashed))
    owners = np.flatnonzero(sizes)
    if not len(owners):
        return out
    sizes = sizes[owners]
    flat = np.fromiter(itertools.chain.from_iterable(hashed), np.uint64, int(sizes.sum()))
    runs = -(-sizes // 255)
    first_run = np.concatenate(([0], np.cumsum(runs)[:-1]))
    first_hash = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    run_starts = np.repeat(first_hash, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    found = np.zeros(len(owners), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(shift)) & LANES, run_starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            found |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[owners] = found
    return out


def post_fingerprints(posts: DataFrame, id_column: str = "tweet_id", text_column: str = "text") -> DataFrame:
    """``post, fingerprint`` of every row; the fingerprint is a signed 64-bit number. One pass, no shuffle."""
    rows = posts.select(F.col(id_column).alias("post"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["post"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [fingerprints([t or "" for t in part.to_pylist()]).view(np.int64) for part in slices(batch.column(1))]
            values = np.concatenate(done) if done else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["post", "fingerprint"])

    return rows.mapInArrow(run, f"post {kind}, fingerprint bigint")


def signature(fingerprint: Column) -> Column:
    """The population counts of a fingerprint's four quarters as one number, 17 values each."""
    mask = F.lit((1 << (BITS // QUARTERS)) - 1)
    code = F.lit(0)
    for quarter in range(QUARTERS):
        part = F.shiftrightunsigned(fingerprint, quarter * BITS // QUARTERS).bitwiseAND(mask)
        code = code * 17 + F.bit_count(part)
    return code.cast("int")


def near_steps(radius: int) -> list[tuple[int, ...]]:
    """Differences between the quarters' counts of two fingerprints within the radius, one of each +/- pair.

    A differing bit changes one count by one, so counts further apart than the radius in sum rule a pair out.
    """
    steps = itertools.product(range(-radius, radius + 1), repeat=QUARTERS)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what lies within the radius in two tiles: one fewer than each group has members.

    Compares every pair exactly, by exclusive-or and bit count in blocks of rows; no list of all
    pairs is kept.
    """
    both = np.concatenate((a, b))
    parent = np.arange(len(both))
    height = max(1, block // max(1, len(b)))
    for low in range(0, len(a), height):
        near = np.bitwise_count(a[low: low + height, None] ^ b[None, :]) <= radius
        rows, columns = np.nonzero(near)
        unite(parent, rows + low, columns + len(a))
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    linked = np.flatnonzero(parent != np.arange(len(both)))
    return both[linked], both[parent[linked]]


def near_links(distinct: DataFrame, radius: int, tile_size: int) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that connect everything within the radius.

    Fingerprints of one signature form tiles of about ``tile_size``; only tiles whose signatures can be
    within the radius are paired.
    """
    coded = distinct.select("fingerprint", signature(F.col("fingerprint")).alias("sig"))
    blocks = coded.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / tile_size).alias("blocks"))
    tiles = cut_lineage(
        coded.join(blocks, "sig")
        .groupBy("sig", F.pmod(F.xxhash64("fingerprint"), "blocks").alias("block"))
        .agg(F.collect_list("fingerprint").alias("members"))
    )
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(s)]) for s in near_steps(radius)])
    digits = [F.floor(F.col("sig") / 17 ** (QUARTERS - 1 - k)) % 17 for k in range(QUARTERS)]
    code, valid = F.lit(0), F.lit(True)
    for k in range(QUARTERS):
        moved = F.col(f"p{k}") + F.col(f"step.d{k}")
        code, valid = code * 17 + moved, valid & moved.between(0, BITS // QUARTERS)
    pairs = (
        tiles.select("sig", "block", *[d.alias(f"p{k}") for k, d in enumerate(digits)], F.explode(steps).alias("step"))
        .filter(valid).select("sig", "block", code.cast("int").alias("sig2"))
        .join(tiles.select(F.col("sig").alias("sig2"), F.col("block").alias("block2")), "sig2")
        .filter("sig <> sig2 or block <= block2")
    )
    full = pairs.join(tiles.withColumnRenamed("members", "a"), ["sig", "block"]).join(
        tiles.select(F.col("sig").alias("sig2"), F.col("block").alias("block2"), F.col("members").alias("b")),
        ["sig2", "block2"],
    ).select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(0), batch.column(1)):
                offsets = column.offsets.to_numpy()
                sides.append((column.values.to_numpy(zero_copy_only=False).view(np.uint64), offsets))
            (values_a, at_a), (values_b, at_b) = sides
            found = [
                compare_tiles(values_a[at_a[k]: at_a[k + 1]], values_b[at_b[k]: at_b[k + 1]], radius)
                for k in range(batch.num_rows)
            ]
            left, right = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["a", "b"])

    return full.mapInArrow(compare, "a bigint, b bigint")


def near_duplicate_posts(
    posts: DataFrame, radius: int = 2, tile_size: int = 16_384, id_column: str = "tweet_id", text_column: str = "text"
) -> DataFrame:
    """The id of each post, its ``fingerprint`` (16 hex digits) and ``component_id``.

    A fingerprint is the majority of the 64-bit hashes of a post's three-word shingles (ASCII letters
    lower-cased, whole text). Posts whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id reachable by links. Nothing is missed: every pair of distinct
    fingerprints is compared or ruled out by its population counts.

    Equal fingerprints meet in one aggregation before any comparison, so a third of all posts being
    copies costs one row. A tile holds distinct fingerprints only, tile pairs give spanning links
    rather than all pairs, and components are found in Spark rounds. The comparison is the part that
    grows faster than the table: about one in a hundred pairs of distinct fingerprints is compared,
    at roughly a nanosecond each.

    Null or empty text: fingerprint 0, linked like any other. Null ids: the row stays; ``component_id``
    is null if no linked post has an id. Repeated rows stay, with equal results. Other columns are not
    read. An empty table gives an empty result.
    """
    require_columns(posts, [id_column, text_column], "posts")
    marked = cut_lineage(post_fingerprints(posts, id_column, text_column))
    distinct = cut_lineage(marked.groupBy("fingerprint").agg(F.min("post").alias("smallest")))
    groups = connected_components(near_links(distinct, radius, tile_size), "a", "b").select(
        F.col("node").alias("fingerprint"), "component"
    )
    members = cut_lineage(groups.join(distinct, "fingerprint"))
    lowest = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_linked = members.join(lowest, "component").select("fingerprint", "component_id")
    by_fingerprint = distinct.join(of_linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "smallest").alias("component_id")
    )
    return marked.join(by_fingerprint, "fingerprint").select(
        F.col("post").alias(id_column),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id",
    )
