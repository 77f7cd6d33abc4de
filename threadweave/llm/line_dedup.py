"""Lines that posts share, dropped from all but the first post, with an index that takes posts in and out."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm.cuckoo import CuckooFilter
from threadweave.llm.salting import salted_join
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
SMALL = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
KEY_BYTES = 16
KEYS_PER_SHARD = 65_536  # about, when an index is begun
CHUNK = 8_192  # keys a filter takes at a time
KEY = "key binary"
FILTER = "shard bigint, filter binary"


@dataclass
class LineIndex:
    """What is known of the lines of the posts put in.

    ``references``: one row (post, text_name, key) per post row and distinct line; ``shared``: those whose key was
    met more than once as the filters saw it; ``counts``: of these keys exactly how many ``posts`` hold them and the
    ``first`` of them; ``filters``: per shard of keys a cuckoo filter with one fingerprint of every distinct key.
    A post is named by whether its id is null, and its id, so that null ids are one post that comes last.
    """

    references: DataFrame
    shared: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_length: int


def line_key(line: str, min_length: int) -> bytes | None:
    """The key of a line: of its text without blanks at the ends, A-Z lower-cased; none if shorter than ``min_length``."""
    bare = line.strip(BLANKS)
    if len(bare) < min_length:
        return None
    return hashlib.blake2b(bare.encode("utf-8", "surrogatepass").translate(SMALL), digest_size=KEY_BYTES).digest()


def _named(posts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return posts.select(
        F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id")).alias("post"),
        F.unhex(F.md5(text)).alias("text_name"), text.alias("text"),
    )


def _references(posts: DataFrame, min_length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = {key for line in text.split("\n") if (key := line_key(line, min_length))}
                rows.extend([row] * len(own))
                keys.extend(own)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("post").take(at), batch.column("text_name").take(at), pa.array(keys, pa.binary())], ["post", "text_name", "key"]
            )

    post = posts.schema["post"].dataType.simpleString()
    return posts.mapInArrow(run, f"post {post}, text_name binary, {KEY}")


def _digests(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=f"V{KEY_BYTES}")


def _hashes(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8")[::2]


def _once_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key once per batch, and whether the batch had it again: a line of all posts shrinks before the shuffle."""
    for batch in batches:
        if len(batch):
            keys, n = np.unique(_digests(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.tolist(), pa.binary()), pa.array(n > 1)], ["key", "again"])


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards).cast("bigint")))


def _old_filter(filters: pa.Table) -> CuckooFilter | None:
    return CuckooFilter.from_bytes(filters.column("filter")[0].as_py()) if len(filters) else None


def _sift(arrivals: pa.Table, filters: pa.Table) -> pa.Table:
    """Keys of a shard that the filters take for met before: in older posts or among these arrivals."""
    old, fresh = _old_filter(filters), CuckooFilter.for_keys(len(arrivals))
    digests, again = _digests(arrivals.column("key")), arrivals.column("again").to_numpy()
    met: list[bytes] = []
    for low in range(0, len(digests), CHUNK):
        keys, first, n = np.unique(digests[low: low + CHUNK], return_index=True, return_counts=True)
        hashes = _hashes(keys)
        seen = fresh.contains(hashes)
        fresh.insert(hashes[~seen])
        seen |= n > 1
        seen[np.isin(keys, digests[low: low + CHUNK][again[low: low + CHUNK]])] = True
        if old is not None:
            seen |= old.contains(hashes)
        met.extend(keys[seen].tolist())
    return pa.table({"key": pa.array(met, pa.binary())})


def _grow(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filter with the new keys; none if they find no room in it, so that it has to be made anew."""
    old = _old_filter(filters)
    hashes = _hashes(_digests(keys.column("key")))
    if old is not None and not old.has_room(len(hashes)):
        out = None
    else:
        grown = old or CuckooFilter.for_keys(2 * len(hashes))  # with room for as many again
        for low in range(0, len(hashes), CHUNK):
            grown.insert(hashes[low: low + CHUNK])
        out = grown.to_bytes()
    shard = (keys if len(keys) else filters).column("shard")[0]
    return pa.table({"shard": pa.array([shard.as_py()], pa.int64()), "filter": pa.array([out], pa.binary())})


def _shrink(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filter without the fingerprints of keys that no post holds any more."""
    kept = _old_filter(filters)
    if kept is None:
        return filters.select(["shard", "filter"])
    kept.delete(_hashes(_digests(keys.column("key"))))
    return pa.table({"shard": filters.column("shard"), "filter": pa.array([kept.to_bytes()], pa.binary())})


def _cogrouped(keys: DataFrame, filters: DataFrame, function, schema: str) -> DataFrame:
    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(function, schema)


def _counted(shared: DataFrame) -> DataFrame:
    return shared.groupBy("key").agg(F.count_distinct("post").alias("posts"), F.min("post").alias("first"))


def _holding(references: DataFrame, keys: DataFrame) -> DataFrame:
    """The references of some keys, one row per key; a key that many posts hold is dealt over tasks by its posts."""
    return salted_join(references, keys, ["key"], ["post"]).select("post", "text_name", "key")


def insert_posts(
    index: LineIndex | None, posts: DataFrame, min_length: int = 10, id_column: str = "tweet_id", text_column: str = "text"
) -> LineIndex:
    """The index with these posts put in; ``None`` begins one with lines of ``min_length`` characters or more.

    The keys of the new lines are dealt over shards, where a cuckoo filter tells lines not met
    before from those that may have been. Only of the latter are posts counted, exactly, from the
    references: what a filter takes for met by mistake gets a count of one. Filters never
    miss, so every line of two posts is counted. Equal lines of a batch shrink to one before they are shuffled.
    Putting in a post again changes nothing that is counted. The given index stays valid.
    """
    require_columns(posts, [id_column, text_column], "posts")
    spark = posts.sparkSession
    min_length = index.min_length if index else min_length
    new = cut_lineage(_references(_named(posts, id_column, text_column), min_length))
    filters = cut_lineage(index.filters) if index else spark.createDataFrame([], FILTER)
    shards = index.shards if index else max(1, math.ceil(new.count() / KEYS_PER_SHARD))
    arrivals = _with_shard(new.select("key").mapInArrow(_once_per_batch, f"{KEY}, again boolean"), shards)
    met = cut_lineage(_cogrouped(arrivals, filters, _sift, KEY).distinct())

    references = index.references.unionByName(new) if index else new
    touched = cut_lineage(_holding(references, met))
    shared, counts = touched, _counted(touched)
    first_seen = _with_shard(new.select("key").distinct(), shards)
    if index:
        shared = shared.unionByName(index.shared.join(met, "key", "left_anti"))
        counts = counts.unionByName(index.counts.join(met, "key", "left_anti"))
        older = index.references.select("key").join(met, "key", "left_semi").distinct()
        first_seen = first_seen.join(older, "key", "left_anti")
    grown = _cogrouped(first_seen, filters, _grow, FILTER)
    if index:
        full = grown.filter("filter is null").select("shard")
        keys = _with_shard(references.select("key").distinct(), shards).join(F.broadcast(full), "shard", "left_semi")
        anew = _cogrouped(keys, spark.createDataFrame([], FILTER), _grow, FILTER)
        grown = grown.filter("filter is not null").unionByName(anew)
    return LineIndex(references, shared, cut_lineage(counts), grown, shards, min_length)


def delete_posts(index: LineIndex, ids: DataFrame, id_column: str = "tweet_id") -> LineIndex:
    """The index without the posts of these ids; ids it does not hold, and null, change nothing.

    Lines of the deleted posts are counted anew from the references that stay, so a line that only
    one post still holds is a line of its own again. Fingerprints of lines that nobody holds leave the filters.
    """
    gone = ids.select(F.col(id_column).alias("id")).filter("id is not null").distinct()
    held = index.references.withColumn("id", F.col("post.id"))
    left = cut_lineage(held.join(gone, "id", "left_anti").drop("id"))
    keys = cut_lineage(held.join(gone, "id", "left_semi").select("key").distinct())
    touched = cut_lineage(_holding(left, keys))
    dead = keys.join(touched.select("key").distinct(), "key", "left_anti")
    return replace(
        index, references=left,
        shared=touched.unionByName(index.shared.join(keys, "key", "left_anti")),
        counts=cut_lineage(_counted(touched).unionByName(index.counts.join(keys, "key", "left_anti"))),
        filters=_cogrouped(_with_shard(dead, index.shards), cut_lineage(index.filters), _shrink, FILTER),
    )


def _without(text: Column, dropped: Column, min_length: int) -> Column:
    @F.arrow_udf("struct<n_lines:bigint,n_dropped:bigint,kept_text:string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(texts.to_pylist(), keys.to_pylist()):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [line for line in lines if line_key(line, min_length) not in gone]
                    text = "\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(text)
            yield pa.StructArray.from_arrays(
                [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["n_lines", "n_dropped", "kept_text"]
            )

    return cut(text, dropped)


def drop_repeated_lines(
    posts: DataFrame, index: LineIndex, id_column: str = "tweet_id", text_column: str = "text"
) -> DataFrame:
    """Posts without the lines that another post of the index holds first: id, ``n_lines``, ``n_dropped``, ``kept_text``.

    A line is told by its text without blanks at the ends, A-Z lower-cased; shorter lines than the index counts always
    stay. A line that two or more posts hold loses all its places except in the post with the smallest id, where
    all of them stay. What stays is joined by line feeds, unchanged. ``posts`` must have been put into the index.

    Null or empty text: one empty line. Rows of one id are one post, each row is returned; null ids are one post that comes
    after all others. Rows that repeat are treated alike. An empty table gives no rows. Other columns are not read.
    """
    require_columns(posts, [id_column, text_column], "posts")
    repeated = index.counts.filter("posts > 1").select("key", "first")
    drops = (
        salted_join(index.shared, repeated, ["key"], ["post"]).filter("post <> first").select("post", "text_name", "key").distinct()
        .groupBy("post", "text_name").agg(F.collect_list("key").alias("dropped"))
    )
    rows = _named(posts, id_column, text_column).join(drops, ["post", "text_name"], "left")
    done = rows.withColumn("done", _without(F.col("text"), F.col("dropped"), index.min_length))
    return done.select(F.col("post.id").alias(id_column), "done.*")
