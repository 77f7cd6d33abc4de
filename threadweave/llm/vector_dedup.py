"""Near-duplicate vectors by sorted projection passes with bounded windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm.components import connected_components, unite
from threadweave.llm.salting import salted_join
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

HASH_BITS = 63  # random hashes concatenated to one sort key
SEED = 20_011


def unit_rows(flat: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows."""
    rows = flat.astype(np.float64).reshape(-1, dimensions)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link: label given, every component given and finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def sort_keys(vectors: DataFrame, passes: int, batch_number: int = 0) -> DataFrame:
    """``pass, dims, label, code, key``: for each pass the vector's random hashes as one number.

    A hash is the side of a random hyperplane; near vectors agree in most, so they share long prefixes
    and lie close in the order of codes.
    """
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, size, batch_number]).standard_normal((size, passes * HASH_BITS))
                rows = unit_rows(flat[(ends[at] - size)[:, None] + np.arange(size)], size)
                sides = (rows @ planes[size] > 0).reshape(len(at), passes, HASH_BITS)
                codes = (sides * powers).sum(axis=2)
                take = pa.array(np.repeat(at, passes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(passes, dtype=np.int32), len(at))), pa.array(np.full(len(take), size, np.int32)),
                     batch.column(1).take(take), pa.array(codes.ravel()), batch.column(0).take(take)],
                    ["pass", "dims", "label", "code", "key"],
                )

    return vectors.select("key", "label", "vector").mapInArrow(
        run, f"pass int, dims int, label {label}, code bigint, key bigint"
    )


def window_blocks(codes: DataFrame, window: int, block: int) -> DataFrame:
    """``block, place, key`` with each order cut into blocks that overlap by one window.

    The orders of all passes and labels stand one after another. A sorted table's row numbers come from
    the row counts of its partitions, so no task sees more than its own range.
    """
    order = ["pass", "dims", "label", "code", "key"]
    ranged = cut_lineage(
        codes.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .select("part", "row", "pass", "dims", "label", "key")
    )
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for part, n in counts:  # as many as there are partitions
        starts[part] = total
        total += n
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("part")) if starts else F.lit(0)
    placed = ranged.withColumn("place", start.cast("bigint") + F.col("row"))
    own = F.floor(F.col("place") / block)
    before = F.when((F.col("place") % block < window) & (own > 0), own - 1)
    return placed.select(
        F.explode(F.array_compact(F.array(own, before))).alias("block"), "place", "pass", "dims", "label", "key"
    )


def compare_window(
    orders: np.ndarray, keys: np.ndarray, rows: np.ndarray, window: int, threshold: float, step: int = 512
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows at most ``window`` places apart in one order with cosine at the threshold."""
    parent = np.arange(len(keys))
    for low in range(0, len(keys), step):
        high = min(len(keys), low + step)
        cosines = rows[low:high] @ rows[low: high + window].T
        a, b = np.nonzero(cosines >= threshold)
        ahead = (b > a) & (b - a <= window) & (orders[low + a] == orders[np.minimum(low + b, len(orders) - 1)])
        unite(parent, a[ahead] + low, b[ahead] + low)
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    linked = np.flatnonzero(parent != np.arange(len(keys)))
    return keys[linked], keys[parent[linked]]


def window_links(vectors: DataFrame, passes: int, window: int, block: int, threshold: float, batch_number: int = 0) -> DataFrame:
    """Links ``a, b`` found in the windows of all passes, enough of them to connect what the windows connect."""
    blocks = window_blocks(sort_keys(vectors, passes, batch_number), window, block).join(vectors.select("key", "vector"), "key")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        left, right = [], []
        for size, part in rows.groupby("dims", sort=False):
            orders = part.groupby(["pass", "label"], sort=False).ngroup().to_numpy()
            unit = unit_rows(np.concatenate(part["vector"].to_list()), size)
            a, b = compare_window(orders, part["key"].to_numpy(), unit, window, threshold)
            left.append(a)
            right.append(b)
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return blocks.groupBy("block").applyInPandas(compare, "a bigint, b bigint")


def tile_pairs(members: DataFrame, tile: int, fields: tuple[str, ...]) -> DataFrame:
    """Every pair of a component's tiles: whether both are one, and the ``fields`` of both as lists."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    tiles = cut_lineage(
        salted_join(members, sizes, ["component"], ["key"])
        .groupBy("component", "tiles", F.pmod(F.xxhash64("key"), "tiles").alias("tile"))
        .agg(F.collect_list(F.struct(*fields)).alias("m"))
        .select("component", "tiles", "tile", *[F.col(f"m.{c}").alias(c) for c in fields])
    )
    pairs = tiles.select("component", "tile", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("tile2"))
    return pairs.join(tiles.drop("tiles"), ["component", "tile"]).join(
        tiles.select("component", F.col("tile").alias("tile2"), *[F.col(c).alias(f"{c}2") for c in fields]),
        ["component", "tile2"],
    ).select((F.col("tile") == F.col("tile2")).alias("same"), *fields, *[f"{c}2" for c in fields])


def exact_links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Links ``a, b`` that connect what any pair of rows of one component connects; every pair is compared."""

    def side(batch: pa.RecordBatch, row: int, suffix: str) -> tuple[np.ndarray, np.ndarray]:
        keys, vectors = (batch.column(c + suffix)[row].values for c in ("key", "vector"))
        return keys.to_numpy(), unit_rows(vectors.flatten().to_numpy(zero_copy_only=False), len(vectors[0]))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, unit = side(batch, row, "")
                key2, unit2 = side(batch, row, "2")
                same = batch.column("same")[row].as_py()
                keys, shift = (key, 0) if same else (np.concatenate((key, key2)), len(key))
                parent = np.arange(len(keys))
                for low in range(0, len(key), 512):
                    a, b = np.nonzero(unit[low: low + 512] @ unit2.T >= threshold)
                    unite(parent, a + low, b + shift)
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
                linked = np.flatnonzero(parent != np.arange(len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[linked]), pa.array(keys[parent[linked]])], ["a", "b"])

    return tile_pairs(members, tile, ("key", "vector")).mapInArrow(link, "a bigint, b bigint")


def all_links(distinct: DataFrame, passes: int, window: int, block: int, threshold: float, quiet: int) -> DataFrame:
    """Links ``a, b`` of all labels: by batches of sorted passes until ``quiet`` batches in a row join nothing more.

    Each label (and length) gets further batches until then, so crowds get as many passes as they need. A label that one window holds as a whole has been compared pair by pair after one batch.
    """
    at = ["label", "dims"]
    sized = distinct.select("key", "label", F.size("vector").alias("dims"), "vector")
    groups = cut_lineage(
        sized.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).withColumn("component", F.monotonically_increasing_id())
    )
    rows = cut_lineage(salted_join(sized, groups, at, ["key"]).select("key", "label", "vector", "n", "component"))
    going, links, number = rows, None, 0
    state = groups.select("component", F.lit(0).cast("bigint").alias("before"), F.lit(0).alias("still"))
    while links is None or not going.isEmpty():
        found = cut_lineage(window_links(going, passes, window, block, threshold, number))
        links = found if links is None else cut_lineage(links.unionByName(found))
        number += 1
        # A node that is not its component's smallest stands for one join.
        nodes = connected_components(links, "a", "b").filter("component <> node").select(F.col("node").alias("key"))
        joins = rows.select("key", "component").join(nodes, "key").groupBy("component").agg(F.count(F.lit(1)).alias("joins"))
        now = F.coalesce("joins", F.lit(0).cast("bigint"))
        state = cut_lineage(
            state.join(joins, "component", "left")
            .select("component", now.alias("before"), F.when(now > F.col("before"), 0).otherwise(F.col("still") + 1).alias("still"))
        )
        more = state.filter(F.col("still") < quiet).select("component")
        going = cut_lineage(
            salted_join(going, more, ["component"], ["key"]).filter(F.col("n") > window + 1).select(rows.columns)
        )
    return links


def compared_links(distinct: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Links ``a, b`` of all labels by comparing every pair of a label."""
    groups = distinct.select("label", F.size("vector").alias("dims")).distinct().withColumn("component", F.monotonically_increasing_id())
    sized = distinct.select("key", "label", F.size("vector").alias("dims"), "vector")
    rows = cut_lineage(salted_join(sized, groups, ["label", "dims"], ["key"]).select("component", "key", "vector"))
    return exact_links(rows, threshold, tile)


def count_links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """``key, n``: with how many other rows of its component each distinct vector links, copies counted.

    Components are cut into tiles; pairs of tiles are compared exactly and only counts come out.
    """
    fields = ("key", "copies", "vector")
    full = tile_pairs(members, tile, fields)

    def side(batch: pa.RecordBatch, row: int, suffix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, copies, vectors = (batch.column(c + suffix)[row].values for c in fields)
        dims = len(vectors) and len(vectors[0])
        return keys.to_numpy(), copies.to_numpy(), unit_rows(vectors.flatten().to_numpy(zero_copy_only=False), dims)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for row in range(batch.num_rows):
                key, copies, unit = side(batch, row, "")
                key2, copies2, unit2 = side(batch, row, "2")
                same = batch.column("same")[row].as_py()
                here, there = np.zeros(len(key), np.int64), np.zeros(len(key2), np.int64)
                for low in range(0, len(key), 512):
                    near = unit[low: low + 512] @ unit2.T >= threshold
                    if same:
                        near[np.arange(len(near)), np.arange(low, low + len(near))] = False
                    here[low: low + 512] += near @ copies2
                    there += copies[low: low + 512] @ near
                keys += [key] if same else [key, key2]
                counts += [here] if same else [here, there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (keys, counts)], ["key", "n"]
            )

    return full.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, passes: int = 8, window: int = 64, block: int = 4096, tile: int = 1024,
    quiet: int = 3, exact: bool = False, exact_tile: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """The id of every vector with ``n_links``, ``component_id`` and ``kept`` (the id is its component's).

    The library's posts carry no dense vectors, so this takes any table with an integer id, an array of
    numbers and a label. Vectors of one label and length link at a cosine of ``threshold`` or more in double
    precision. Equal vectors are one from the start. The vectors are ordered by ``HASH_BITS`` concatenated random
    hashes in each of ``passes`` passes and each is compared with the ``window`` next ones; batches of such passes
    follow, with new hashes, until ``quiet`` in a row join nothing more in the label. The verified links are united to components
    (``component_id`` is the smallest id), and inside a component every pair is compared exactly, so ``n_links`` counts
    all of a vector's direct links there, copies included. Links are real; one between two components that no
    pass has joined when that many batches find nothing is missed. With ``exact`` all pairs of a label are compared instead.

    Null or zero vectors, null labels, and null, infinite or NaN components link with nothing: 0 links,
    a component of their own. Null ids: the row stays, with null component if no linked row has an id,
    and is not kept. Repeated rows stay and link with each other. Other columns are not read. An empty
    table gives an empty result.

    Copies are counted before anything is compared. Blocks have a fixed number of rows whatever the
    labels, and large components are cut into tiles; the exact counting is the part that grows with the
    square of the largest component.
    """
    require_columns(vectors, [id_column, vector_column, label_column], "vectors")
    rows = vectors.select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"),
        F.transform(F.col(vector_column), lambda x: x.cast("double")).alias("vector"),
    )
    good = usable(F.col("vector"), F.col("label"))
    distinct = cut_lineage(
        rows.filter(good).groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("smallest"))
        .withColumn("key", F.monotonically_increasing_id())
    )
    links = cut_lineage(
        compared_links(distinct, threshold, exact_tile) if exact else all_links(distinct, passes, window, block, threshold, quiet)
    )
    groups = connected_components(links, "a", "b").select(F.col("node").alias("key"), "component")
    members = cut_lineage(groups.join(distinct, "key"))
    lowest = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    counted = salted_join(members.select("key", "component"), lowest, ["component"], ["key"]).join(
        count_links(members, threshold, tile), "key", "left"
    ).select("key", "component_id", "n")
    found = distinct.join(counted, "key", "left").select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "smallest").alias("component_id"),
    )
    linked = rows.filter(good).join(found, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.filter(~good).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
