"""Token counts: byte-pair merging with a heap of pairs and a linked list of symbols."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm.pretokens import ChunkMemory, Vocabulary, slices, vocabulary
from threadweave.schema import require_columns


def count_merges(word: list[int], pairs: dict[int, tuple[int, int]], base: int) -> int:
    """How many merges byte-pair merging makes in one word.

    ``word`` holds the symbols of its bytes, ``pairs`` the rank and result of each mergeable pair by
    ``left * base + right``. The heap holds rank and place of adjacent pairs; the lowest rank, and of
    equal ranks the leftmost, merges next. A popped pair whose symbols have changed is passed over.
    """
    size = len(word)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap = []
    look_up = pairs.get
    for place in range(size - 1):
        found = look_up(word[place] * base + word[place + 1])
        if found:
            heap.append((found[0], place, found[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, place, result = heapq.heappop(heap)
        left = word[place]
        right_place = after[place]
        if left < 0 or right_place >= size:
            continue
        found = look_up(left * base + word[right_place])
        if not found or found[0] != rank:
            continue
        merges += 1
        word[place] = result
        word[right_place] = -1
        following = after[right_place]
        after[place] = following
        if following < size:
            before[following] = place
            found = look_up(result * base + word[following])
            if found:
                heapq.heappush(heap, (found[0], place, found[1]))
        earlier = before[place]
        if earlier >= 0:
            found = look_up(word[earlier] * base + result)
            if found:
                heapq.heappush(heap, (found[0], earlier, found[1]))
    return merges


@lru_cache(maxsize=2)
def _memory(path: str) -> tuple[Vocabulary, ChunkMemory]:
    vocab = vocabulary(path)
    pairs = {
        int(key): (rank, int(result)) for rank, (key, result) in enumerate(zip(vocab.pair_keys, vocab.pair_ids))
    }
    symbols = vocab.byte_ids.tolist()

    def solve(words: list[str]) -> list[int]:
        counts = []
        for word in words:
            raw = word.encode()
            counts.append(len(raw) - count_merges([symbols[b] for b in raw], pairs, vocab.base))
        return counts

    return vocab, ChunkMemory(dict.fromkeys(vocab.specials, 1), solve, sum, most=450_000)


def token_count(text: Column, tokenizer_path: str) -> Column:
    """The number of tokens of a text; 0 for a null one."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab, memory = _memory(tokenizer_path)
        for batch in batches:
            done: list[int] = []
            for part in slices(batch):
                done.extend(map(sum, memory.values(vocab, [t or "" for t in part.to_pylist()])))
            yield pa.array(done, pa.int64())

    return count(text)


def count_post_tokens(
    posts: DataFrame, tokenizer_path: str, limit: int = 1024, id_column: str = "tweet_id", text_column: str = "text"
) -> DataFrame:
    """The id of each post with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Counts equal the length of the tokenizers library's ids for the byte-level BPE file at
    ``tokenizer_path`` (no added special tokens, truncation or padding; a special string inside a text
    is one token). Each distinct word is merged once with a heap and a linked list: its count is its
    bytes less its merges; no identifiers are given out. The file must lie at that path on every executor.

    One row per post, no shuffle; whole texts. Null or empty text: 0 bytes, 0 tokens. Null ids and
    repeated rows stay, other columns are not read, an empty table gives an empty result.
    """
    require_columns(posts, [id_column, text_column], "posts")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    counted = posts.select(
        F.col(id_column).alias(id_column), F.octet_length(text).cast("bigint").alias("n_bytes"),
        token_count(text, tokenizer_path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
