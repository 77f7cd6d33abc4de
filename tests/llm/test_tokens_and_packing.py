"""Encoding, decoding, counting and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadweave.llm import bpe, packing, pretokens, token_counts

TEXTS = [
    "My router drops the line every evening, please help!", "", "  two  spaces \n\n and\tbreaks \r\n", "it's we'll they'VE",
    "special <|endoftext|> inside <|endoftext|>", "日本語 テキスト 🙂🙂 ​", "aaaa" * 300, "\x1c \x1d x　y \x85",
    " lead and trail ", "Ünïcødé ñandú 12345 3.14", "word " * 5000, "."*700,
]


def le(ids):
    return np.array(ids, "<u4").tobytes()


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    parts = [*" \n\tab'sre1!é日🙂", "  ", "<|endoftext|>", "the", " ing"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def cases(library):
    texts = TEXTS + odd_texts(3000)
    return texts, [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merge_rounds_give_the_library_ids(tokenizer_path, cases):
    texts, ids = cases
    assert bpe.encode_texts(tokenizer_path, texts) == [le(i) for i in ids]


def test_decoding_gives_the_library_text(tokenizer_path, library, cases):
    _, ids = cases
    assert bpe.decode_texts(tokenizer_path, [le(i) for i in ids]) == [library.decode(i, skip_special_tokens=False) for i in ids]
    broken = [[220, 163], [163]]  # bytes that are no UTF-8
    assert bpe.decode_texts(tokenizer_path, [le(i) for i in broken]) == [library.decode(i, skip_special_tokens=False) for i in broken]


def test_heap_counts_equal_the_library(tokenizer_path, cases):
    texts, ids = cases
    vocab, memory = token_counts._memory(tokenizer_path)
    assert [sum(v) for v in memory.values(vocab, texts)] == [len(i) for i in ids]


def test_packing_ids_equal_the_library(tokenizer_path, library, cases):
    texts, ids = cases
    assert [packing.token_ids(tokenizer_path, t).tolist() for t in texts] == ids
    tokens = [t.decode("utf-8", "ignore") for t in pretokens.vocabulary(tokenizer_path).token_bytes.values()]
    rng = random.Random(9)
    joined = ["".join(rng.choices(tokens, k=3)).replace("<|", "") for _ in range(20_000)]
    found = library.encode_batch(joined, add_special_tokens=False)
    assert [packing.token_ids(tokenizer_path, t).tolist() for t in joined] == [f.ids for f in found]


def test_memory_stays_bounded_and_right(tokenizer_path, library):
    vocab = pretokens.vocabulary(tokenizer_path)
    memory = pretokens.ChunkMemory({}, lambda words: [w for w in words], "".join, most=50)
    texts = odd_texts(400, seed=8)
    for k in range(0, len(texts), 10):
        assert ["".join(v) for v in memory.values(vocab, [t.replace("<|endoftext|>", "") for t in texts[k: k + 10]])] == [
            t.replace("<|endoftext|>", "") for t in texts[k: k + 10]
        ]
        assert len(memory.known) < 50 + 400 and len(memory.older) < 50 + 400


def test_encode_posts_rows(posts, tokenizer_path, library):
    rows = [(str(k), t) for k, t in enumerate(TEXTS)] + [("x", None), (None, "null id"), ("0", TEXTS[0])]
    table = posts([(*r, "n", 1) for r in rows], "tweet_id string, text string, n_tokens string, token_ids int")
    got = bpe.round_trip_posts(table, tokenizer_path).collect()
    want = {(i, le(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows}
    assert {(r["tweet_id"], bytes(r["token_ids"]), r["decoded_text"]) for r in got} == want and len(got) == len(rows)
    assert all(r["n_tokens"] == len(r["token_ids"]) // 4 for r in got)
    decoded = bpe.decode_posts(bpe.encode_posts(table, tokenizer_path), tokenizer_path).collect()
    assert {r["decoded_text"] for r in decoded} == {t or "" for _, t in rows}
    assert bpe.encode_posts(table.limit(0), tokenizer_path).collect() == []


def test_count_posts_rows(posts, tokenizer_path, library):
    rows = [("a", "one two three"), ("b", None), (None, ""), ("a", "one two three"), ("long", "help me " * 30_000)]
    got = token_counts.count_post_tokens(posts([(*r, 0) for r in rows], "tweet_id string, text string, n_bytes int"), tokenizer_path)
    want = sorted((i or "", len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    assert sorted((r["tweet_id"] or "", r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want
    assert token_counts.count_post_tokens(posts([]), tokenizer_path).collect() == []


def smallest_number_of_bins(lengths, capacity):
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[k]:
                place(k + 1, rooms[:j] + [rooms[j] - lengths[k]] + rooms[j + 1:])
        place(k + 1, rooms + [capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_bound_below_optimum_below_packing(lengths):
    values = np.array(lengths)
    bins, offsets, used = packing.best_fit_decreasing(values, 20)
    optimum = smallest_number_of_bins(lengths, 20)
    assert packing.lower_bound(values, 20) <= optimum <= used
    for b in range(used):
        inside = sorted((offsets[k], lengths[k]) for k in range(len(lengths)) if bins[k] == b)
        assert inside[0][0] == 0 and sum(n for _, n in inside) <= 20
        assert all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:]))


def test_bound_beats_the_plain_sum():
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3  # two never fit together
    assert packing.lower_bound(np.array([7] * 6), 20) == 3
    assert packing.lower_bound(np.array([], int), 20) == 0


@pytest.mark.parametrize("per_part", [7, 10_000])
def test_pack_posts_places_every_id(posts, tokenizer_path, library, per_part):
    rng = random.Random(2)
    rows = [(str(k), " ".join(rng.choices(["late", "parcel", "again", "why", "no", "reply"], k=rng.randint(0, 60)))) for k in range(60)]
    rows += [("long", "where is my parcel " * 90), ("n", None), (None, "no id"), ("0", rows[0][1])]
    table = posts([(*r, 9) for r in rows], "tweet_id string, text string, offset int")
    got = packing.pack_posts(table, tokenizer_path, capacity=64, pieces_per_part=per_part).collect()
    wanted = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        wanted += [(i or "", k, a, b - a, zlib.crc32(le(ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["tweet_id"] or "", r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(wanted)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 64
    lengths = np.array([w[3] for w in wanted])
    bound = packing.lower_bound(lengths, 64)
    assert bound <= len(sequences) <= (bound + 1 if per_part > 100 else bound + 4)


def test_pack_empty_table(posts, tokenizer_path):
    assert packing.pack_posts(posts([]), tokenizer_path).collect() == []
    with pytest.raises(ValueError):
        packing.pack_posts(posts([]), tokenizer_path, capacity=0)
