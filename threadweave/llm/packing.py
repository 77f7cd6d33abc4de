"""Best-fit packing of tokenised posts into sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm.pretokens import WORD_PATTERN, Vocabulary, vocabulary
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

STEPS = 24  # members of the rounding family of dual feasible functions


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins no packing of these lengths can be below.

    The largest bound of two families of dual feasible functions: one that, for every threshold up to
    half a bin, fills up items that leave less than the threshold and drops items below it; and one
    that rounds lengths down to shares of k bins unless they are exact (k + 1)-ths.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    weight = np.cumsum(counts * sizes)
    number = np.cumsum(counts)
    cut = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - cut]
    below = np.where(cut > 0, weight[np.maximum(cut - 1, 0)], 0)
    middle = weight[capacity - cut] - below
    best = int(np.max(large - (-middle // capacity)))
    for k in range(1, STEPS + 1):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -int(-(counts * value).sum() // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins.

    Longest first, each into the fullest bin it fits. The room left in open bins is kept as the bits
    of one number, so the tightest bin is its lowest bit at or above the length.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, used
            used += 1
        bins[item], offsets[item] = chosen, capacity - room
        if room > length:
            open_bins[room - length].append(chosen)
            rooms |= 1 << (room - length)
    return bins, offsets, used


@lru_cache(maxsize=2)
def _encoding(path: str) -> tuple[Vocabulary, tiktoken.Encoding]:
    """The tokenizers file's own vocabulary in tiktoken, which gives the same ids several times faster.

    That takes token ids in the order of the merges, which is checked.
    """
    vocab = vocabulary(path)
    if len(vocab.pair_ids) and not (np.diff(vocab.pair_ids) > 0).all():
        raise ValueError("token ids do not follow the order of merges")
    ranks = {token: i for i, token in vocab.token_bytes.items() if i not in vocab.specials.values()}
    return vocab, tiktoken.Encoding("posts", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(path: str, text: str) -> np.ndarray:
    """Ids as the tokenizers library gives them without added special tokens."""
    vocab, encoding = _encoding(path)
    return np.concatenate([
        [vocab.specials[s]] if s in vocab.specials else encoding.encode_to_numpy(s, disallowed_special=())
        for s in vocab.segments(text)
    ] or [[]]).astype("<u4")


def cut_pieces(
    posts: DataFrame, tokenizer_path: str, capacity: int, separator_id: int, id_column: str, text_column: str
) -> DataFrame:
    """``post, piece, start, length, ids_crc32`` of every post's ids followed by the separator.

    Only a post longer than the capacity is cut; its first piece takes the remainder, the others are full.
    """
    rows = posts.select(
        F.col(id_column).alias("post"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )
    kind = rows.schema["post"].dataType.simpleString()
    end = int(separator_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = token_ids(tokenizer_path, text.as_py()).tobytes() + end
                total = len(ids) // 4
                low, high, number = 0, (total - 1) % capacity + 1, 0
                while low < total:
                    at.append(row)
                    piece.append(number)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(ids[4 * low: 4 * high]))
                    low, high, number = high, high + capacity, number + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["post", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, f"post {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _pack(pieces: DataFrame, capacity: int, pieces_per_part: int, round_: int) -> DataFrame:
    """Deal the pieces evenly at random into parts and pack each part on its own.

    Every piece gets its part by its own row number, so equal or null ids meet in no common part.
    Adds ``sequence_id, offset``, whether its part has a gap to its bound, and whether its bin is the
    part's emptiest.
    """
    parts = max(1, -(-pieces.count() // pieces_per_part))
    dealt = pieces.withColumn(
        "part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(parts))
    )
    columns = ["post", "piece", "start", "length", "ids_crc32"]
    kind = pieces.schema["post"].dataType.simpleString()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        emptiest = int(np.argmin(fill))
        out = rows[columns].copy()
        out["sequence_id"] = (round_ << 56) + (int(rows["part"].iloc[0]) << 28) + bins
        out["offset"] = offsets
        out["gap"] = used > lower_bound(lengths, capacity)
        out["loose"] = (bins == emptiest) & (fill[bins] < capacity)
        return out

    return cut_lineage(dealt.groupBy("part").applyInPandas(
        pack, f"post {kind}, piece int, start bigint, length bigint, ids_crc32 bigint,"
        " sequence_id bigint, offset bigint, gap boolean, loose boolean",
    ))


def pack_posts(
    posts: DataFrame, tokenizer_path: str, capacity: int = 2048, separator_id: int = 0,
    pieces_per_part: int = 16_384, rounds: int = 4, id_column: str = "tweet_id", text_column: str = "text",
) -> DataFrame:
    """Place every post in as few token sequences of at most ``capacity`` as can be found.

    One row per piece: the id, ``piece`` (from 0), ``start`` (the post's ids before it), ``length``,
    ``ids_crc32`` (its ids as little-endian unsigned 32-bit numbers), ``sequence_id`` and ``offset`` (its
    place there; sequences have no gaps). A post is its ids from the tokenizers library, without added
    special tokens, followed by ``separator_id``. Posts longer than ``capacity`` are cut into full
    pieces, the first taking the remainder.

    Pieces are dealt into parts of about ``pieces_per_part`` and each part is packed best-fit
    decreasing. Dual-feasible-function bounds certify a part's number of bins. Parts with a gap to
    their bound, and the emptiest bin of every part, exchange their pieces: they are dealt anew among
    each other and packed again, for at most ``rounds`` rounds and as long as bins are saved.

    Null or empty text: the separator alone. Null ids and repeated rows are packed like any other row.
    Other columns are not read. An empty table gives an empty result. Texts are read once; everything
    after works on narrow rows, and the driver sees only counts.
    """
    require_columns(posts, [id_column, text_column], "posts")
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = cut_lineage(cut_pieces(posts, tokenizer_path, capacity, separator_id, id_column, text_column))
    packed = _pack(pieces, capacity, pieces_per_part, 0)
    settled: list[DataFrame] = []
    bins = F.count_if(F.col("offset") == 0)
    for round_ in range(1, rounds + 1):
        exchanged = packed.filter("gap or loose")
        before = exchanged.agg(bins.alias("n")).first()["n"]
        if before < 2:
            break
        again = _pack(exchanged, capacity, pieces_per_part, round_)
        if again.agg(bins.alias("n")).first()["n"] >= before:
            break
        settled.append(packed.filter("not (gap or loose)"))
        packed = again
    for done in settled:
        packed = packed.unionByName(done)
    return packed.select(
        F.col("post").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
