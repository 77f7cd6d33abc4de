"""Byte-pair encoding and decoding: merge rounds over all words of a batch in one flat numpy array."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm.pretokens import ChunkMemory, Vocabulary, slices, vocabulary
from threadweave.schema import require_columns

NONE = np.int64(1 << 40)  # the rank of a pair that does not merge
ROUND_BYTES = 1 << 20


class MergeTable:
    """Mergeable pairs sorted by key, with rank and result, for binary search."""

    def __init__(self, vocab: Vocabulary):
        order = np.argsort(vocab.pair_keys)
        self.base = np.int64(vocab.base)
        self.byte_ids = vocab.byte_ids
        self.keys, self.ranks, self.results = vocab.pair_keys[order], order.astype(np.int64), vocab.pair_ids[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` if none) and place in the table of each pair."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE), at


def encode_words(table: MergeTable, words: list[bytes]) -> list[bytes]:
    """Token ids of each word as little-endian 32-bit numbers.

    All symbols of all words lie in one array. A round finds every word's lowest-ranked adjacent
    pair and merges all its occurrences, left to right; words without a pair left leave the array.
    """
    out: list[bytes] = [b""] * len(words)
    low = 0
    while low < len(words):  # parts of about ROUND_BYTES keep the arrays small
        high, size = low, 0
        while high < len(words) and (high == low or size + len(words[high]) <= ROUND_BYTES):
            size += len(words[high])
            high += 1
        _merge_rounds(table, words[low:high], out, low)
        low = high
    return out


def _merge_rounds(table: MergeTable, words: list[bytes], out: list[bytes], first: int) -> None:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    names = np.flatnonzero(lengths) + first  # which word each run of symbols is
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return
    symbols = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.zeros(len(symbols), bool)
    ends[np.cumsum(lengths) - 1] = True
    ranks = np.full(len(symbols), NONE)
    places = np.zeros(len(symbols), np.int64)
    inner = np.flatnonzero(~ends)
    ranks[inner], places[inner] = table.look_up(symbols[inner], symbols[inner + 1])
    while True:
        starts = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
        lowest = np.minimum.reduceat(ranks, starts)
        open_words = lowest < NONE
        if not open_words.all():
            spans = np.diff(np.append(starts, len(symbols)))
            done = symbols.astype("<u4").tobytes()
            for k in np.flatnonzero(~open_words).tolist():
                out[names[k]] = done[4 * starts[k]: 4 * (starts[k] + spans[k])]
            if not open_words.any():
                return
            stay = np.repeat(open_words, spans)
            symbols, ends, ranks, places = symbols[stay], ends[stay], ranks[stay], places[stay]
            names, lowest, spans = names[open_words], lowest[open_words], spans[open_words]
        else:
            spans = np.diff(np.append(starts, len(symbols)))
        merge = np.flatnonzero(ranks == np.repeat(lowest, spans))
        if len(merge) > 1:  # of overlapping pairs (aaa) every other one, from the left
            breaks = np.flatnonzero(np.diff(merge) != 1) + 1
            run_start = np.repeat(np.concatenate(([0], breaks)), np.diff(np.concatenate(([0], breaks, [len(merge)]))))
            merge = merge[(np.arange(len(merge)) - run_start) % 2 == 0]
        symbols[merge] = table.results[places[merge]]
        ends[merge] = ends[merge + 1]
        keep = np.ones(len(symbols), bool)
        keep[merge + 1] = False
        at = merge - np.arange(len(merge))  # where the merged symbols stand afterwards
        symbols, ends, ranks, places = symbols[keep], ends[keep], ranks[keep], places[keep]
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        changed = np.flatnonzero(touched)
        live = changed[~ends[changed]]
        ranks[changed] = NONE
        ranks[live], places[live] = table.look_up(symbols[live], symbols[live + 1])


@lru_cache(maxsize=2)
def _memory(path: str) -> tuple[Vocabulary, ChunkMemory]:
    vocab = vocabulary(path)
    table = MergeTable(vocab)
    return vocab, ChunkMemory(
        {s: int(i).to_bytes(4, "little") for s, i in vocab.specials.items()},
        lambda words: encode_words(table, [w.encode() for w in words]), b"".join,
    )


def encode_texts(tokenizer_path: str, texts: list[str]) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers."""
    vocab, memory = _memory(tokenizer_path)
    return [b"".join(values) for values in memory.values(vocab, texts)]


def decode_texts(tokenizer_path: str, token_ids: list[bytes]) -> list[str]:
    """The text of each row of ids, special tokens included; bytes that are no UTF-8 are replaced."""
    by_id = vocabulary(tokenizer_path).token_bytes
    return [
        b"".join(map(by_id.__getitem__, np.frombuffer(row, "<u4").tolist())).decode("utf-8", "replace")
        for row in token_ids
    ]


def encode_posts(
    posts: DataFrame, tokenizer_path: str, id_column: str = "tweet_id", text_column: str = "text"
) -> DataFrame:
    """Posts as token ids: the id, ``token_ids`` (little-endian unsigned 32-bit numbers) and ``n_tokens``.

    Ids are those of the tokenizers library for the byte-level BPE file at ``tokenizer_path`` without
    added special tokens, truncation or padding; special strings inside a text become their own ids.
    The file must lie at that path on every executor. One row per post, no shuffle; whole texts.

    Null or empty text: no ids, ``n_tokens`` 0. Null ids and repeated rows stay. Other columns are not
    read, whatever their names. An empty table gives an empty result. Each Python worker remembers a
    bounded number of words, so memory does not grow with the table.
    """
    return round_trip_posts(posts, tokenizer_path, id_column, text_column, decode=False)


def round_trip_posts(
    posts: DataFrame, tokenizer_path: str, id_column: str = "tweet_id", text_column: str = "text", decode: bool = True
) -> DataFrame:
    """``encode_posts`` and, from the ids, ``decoded_text``, in one pass over the texts."""
    require_columns(posts, [id_column, text_column], "posts")
    fields = "token_ids binary" + ", decoded_text string" * decode

    @F.arrow_udf(f"struct<{fields.replace(' binary', ':binary').replace(' string', ':string')}>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids: list[bytes] = []
            texts: list[str] = []
            for part in slices(batch):
                encoded = encode_texts(tokenizer_path, [t or "" for t in part.to_pylist()])
                ids.extend(encoded)
                if decode:
                    texts.extend(decode_texts(tokenizer_path, encoded))
            columns = [pa.array(ids, pa.binary()), *([pa.array(texts, pa.string())] if decode else [])]
            yield pa.StructArray.from_arrays(columns, ["token_ids", "decoded_text"][: len(columns)])

    return posts.select(
        F.col(id_column).alias(id_column), encode(F.col(text_column).cast("string")).alias("_encoded")
    ).select(
        id_column, "_encoded.*", F.expr("octet_length(_encoded.token_ids) div 4").alias("n_tokens")
    )


def decode_posts(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Add ``decoded_text``, the text of ``token_ids``, to rows of ``encode_posts``.

    Null ids give an empty text; an id the vocabulary does not hold fails. A column of that name is replaced.
    """
    require_columns(encoded, ["token_ids"], "encoded posts")

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(decode_texts(tokenizer_path, [ids or b"" for ids in batch.to_pylist()]), pa.string())

    return encoded.withColumn("decoded_text", decode(F.col("token_ids")))
