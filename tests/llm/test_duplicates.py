"""Near-duplicate posts and vectors, and components, against brute force."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from threadweave.llm import components, shingle_dedup, simhash
from threadweave.llm import vector_dedup as VD


def smallest_reachable(names, linked):
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[k: k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(n, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}é" if k % 7 == 0 else f"Word{k}" for k in range(400)]
    out = []
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(1, 300))
        out.append(" ".join(base))
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] = "changed"
            out.append("\n".join(base))
    return out + out[:5] + ["", None, " \t", "one", "one two", "ONE two", "x " * 3000]


def test_fingerprints_equal_the_plain_ones():
    cases = texts(60)
    got = simhash.fingerprints([t or "" for t in cases])
    assert [int(x) for x in got] == [slow_fingerprint(t) for t in cases]


@pytest.mark.parametrize("radius,tile", [(2, 16_384), (2, 8), (0, 16), (5, 8)])
def test_posts_equal_brute_force(posts, radius, tile):
    rows = [(k, t, "x") for k, t in enumerate(texts(80))]
    table = posts(rows, "tweet_id bigint, text string, fingerprint string").repartition(3)
    got = {r["tweet_id"]: r for r in simhash.near_duplicate_posts(table, radius=radius, tile_size=tile).collect()}
    marks = {k: slow_fingerprint(t) for k, t, _ in rows}
    want = smallest_reachable(marks, [(a, b) for a in marks for b in marks if a < b and bin(marks[a] ^ marks[b]).count("1") <= radius])
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == marks
    assert {k: r["component_id"] for k, r in got.items()} == want


def test_planted_near_fingerprints_are_linked_whatever_their_counts():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = base ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    a, b = simhash.compare_tiles(base, flips, 2, block=1000)
    linked = smallest_reachable([*map(int, base), *map(int, flips)], [(int(x), int(y)) for x, y in zip(a, b)])
    assert all(linked[int(x)] == linked[int(y)] for x, y in zip(base, flips))


def test_steps_cover_every_pair_within_the_radius():
    steps = set(simhash.near_steps(2))
    assert all(sum(map(abs, s)) <= 2 for s in steps)
    assert (0,) * 4 in steps and len(steps) == 21  # 41 differences, one of each +/- pair


def test_post_rows(posts):
    same = "my phone keeps restarting since the update and nobody answers"
    rows = [(None, same), ("7", same), ("7", same), (None, "alone"), ("3", None), ("9", "")]
    got = simhash.near_duplicate_posts(posts(rows)).collect()
    assert sorted((r["tweet_id"] or "", r["component_id"] or "") for r in got) == sorted(
        [("", "7"), ("7", "7"), ("7", "7"), ("", ""), ("3", "3"), ("9", "3")])
    assert simhash.near_duplicate_posts(posts([])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(posts, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    links += [(5000, k) for k in range(5001, 5100)] + [(1, 1), (2, None)]
    got = {r["node"]: r["component"] for r in components.connected_components(posts(links, "a bigint, b bigint"), "a", "b").collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == smallest_reachable({x for pair in real for x in pair}, real)


def test_unite_is_union_find():
    rng = random.Random(6)
    parent = np.arange(200)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    for k in range(0, 120, 30):
        components.unite(parent, *(np.array(x) for x in zip(*pairs[k: k + 30])))
    while not np.array_equal(parent[parent], parent):
        parent = parent[parent]
    assert dict(enumerate(parent.tolist())) == smallest_reachable(range(200), pairs)


def vectors_table(seed=0, n=150, dims=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 4))):
            noise = rng.standard_normal(dims) * rng.choice([0.02, 0.15, 0.19, 0.25])
            rows.append(((base + noise).astype(np.float32).tolist(), int(k % 3)))
    centre = rng.standard_normal(dims)
    rows += [((centre + rng.standard_normal(dims) * 0.05).astype(np.float32).tolist(), 1) for _ in range(90)]
    rows += [(rows[0][0], rows[0][1])] * 20
    return [(1000 - k, v, label) for k, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("window,block,tile", [(64, 4096, 1024), (16, 50, 16)])
def test_vectors_against_brute_force(posts, window, block, tile):
    rows = vectors_table()
    table = posts(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r for r in VD.near_duplicate_vectors(table, window=window, block=block, tile=tile).collect()}
    unit = np.array([v for _, v, _ in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    linked = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and near[a, b] and rows[a][2] == rows[b][2]]
    count = dict.fromkeys((r[0] for r in rows), 0)
    for a, _ in linked:
        count[rows[a][0]] += 1
    want = smallest_reachable(count, [(rows[a][0], rows[b][0]) for a, b in linked])
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.99 * len(linked)
    assert all(got[k]["n_links"] <= n for k, n in count.items())
    assert sum(got[k]["component_id"] == c for k, c in want.items()) >= 0.99 * len(want)
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_vector_rows(posts):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, [1.0, 0.0], None), (4, None, 5), (5, [0.0, 0.0], 5),
        (6, [1.0, None], 5), (7, [nan, 1.0], 5), (8, [inf, 1.0], 5), (9, [], 5), (10, [1.0, 0.0, 0.0], 5), (None, [1e300, 0.0], 5),
        (11, [-1.0, 0.0], 5), (12, [1.0, 0.0], 6),
    ]
    got = VD.near_duplicate_vectors(posts([(*r, True) for r in rows], "vec_id bigint, embedding array<double>, label int, kept boolean"))
    found = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got.collect()), key=str)
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert found == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (0, 3, 1, False), *alone], key=str)
    assert VD.near_duplicate_vectors(posts([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[k: k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_texts_equal_brute_force_by_shingle_similarity(posts):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(3, 200))
        rows.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append("\n".join(copy))
    crowd = rng.choices(words, k=60)
    rows += [" ".join(crowd[:k] + ["odd"] + crowd[k + 1:]) for k in range(60)]  # many within 0.8, many not
    rows += rows[:5] + ["", None, " \t", "one", "ONE", "one two"]
    sets = [shingle_set(t) for t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if not sets[a] | sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    table = posts(list(enumerate(rows)), "tweet_id bigint, text string").repartition(3)
    got = {r["tweet_id"]: r["component_id"] for r in shingle_dedup.near_duplicate_texts(table).collect()}
    assert got == smallest_reachable(range(len(rows)), near)
    assert shingle_dedup.near_duplicate_texts(posts([])).collect() == []


def test_bands_find_pairs_at_similarity_of_eight_tenths():
    rng = random.Random(9)
    found = 0
    for _ in range(1000):
        common, a, b = ([rng.getrandbits(64) for _ in range(n)] for n in (80, 10, 10))
        (left, right), sketches = shingle_dedup.band_codes([common + a, common + b], 20, 4)
        apart = differing_bits(*sketches)
        found += any(x == y for x, y in zip(left, right)) and apart <= shingle_dedup.sketch_radius(0.8, 80)
    assert found >= 998


def differing_bits(a, b):
    return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))


def test_sketches_rule_out_pairs_that_share_a_passage():
    """Texts of one long passage and own words: similarity 0.25, often in one bucket, seldom near by sketch."""
    rng = random.Random(10)
    radius, passed, bits = shingle_dedup.sketch_radius(0.8, 80), 0, 0
    for _ in range(1000):
        passage, a, b = ([rng.getrandbits(64) for _ in range(n)] for n in (40, 60, 60))
        apart = differing_bits(*shingle_dedup.band_codes([passage + a, passage + b], 20, 4)[1])
        passed, bits = passed + (apart <= radius), bits + apart
    assert passed <= 60
    assert abs(bits / 1000 - 80 * 0.375) < 1


def test_radius_of_sketches_follows_the_binomial_tail():
    for similarity, bits in ((0.8, 80), (0.5, 64), (1.0, 80)):
        radius, differ = shingle_dedup.sketch_radius(similarity, bits), (1 - similarity) / 2
        tail = [math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(bits + 1)]
        assert sum(tail[radius + 1:]) <= shingle_dedup.MISSED + 1e-12
        assert radius == 0 or sum(tail[radius:]) > shingle_dedup.MISSED


def test_crowd_around_one_passage_equals_brute_force(posts):
    """Hundreds of texts with one long passage, few of them near copies of each other."""
    rng = random.Random(11)
    words = [f"v{k}" for k in range(2000)]
    passage = rng.choices(words, k=60)
    rows = [" ".join(passage + rng.choices(words, k=rng.randint(20, 60))) for _ in range(250)]
    for k in range(0, 40):
        copy = rows[k].split()
        copy[rng.randrange(60, len(copy))] = "changed"
        rows.append(" ".join(copy))
    sets = [shingle_set(t) for t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    table = posts(list(enumerate(rows)), "tweet_id bigint, text string").repartition(3)
    got = {r["tweet_id"]: r["component_id"] for r in shingle_dedup.near_duplicate_texts(table).collect()}
    assert got == smallest_reachable(range(len(rows)), near)


@pytest.mark.parametrize("exact", [False, True])
def test_pairs_inside_a_crowd_are_found(posts, exact):
    """Planted pairs in one label whose vectors all have a mutual cosine of about 0.95; fixed passes find a part."""
    rng = np.random.default_rng(12)
    dims, n = 64, 3000

    def direction(m):
        rows = rng.standard_normal((m, dims))
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    crowd = direction(1) + direction(n) * np.sqrt(1 / 0.95 - 1)
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    crowd = np.concatenate((crowd, crowd[:300] + direction(300) * 0.17))
    table = posts([(k, v.tolist(), 1) for k, v in enumerate(crowd)], "vec_id bigint, embedding array<double>, label int").repartition(4)
    unit = crowd / np.linalg.norm(crowd, axis=1, keepdims=True)
    near = np.argwhere(np.triu(unit @ unit.T >= 0.98, 1))
    want = smallest_reachable(range(len(crowd)), near.tolist())
    got = VD.near_duplicate_vectors(table, passes=4, window=4, exact=exact).collect()
    linked = [r for r in got if want[r["vec_id"]] != r["vec_id"]]
    assert len(linked) >= 250
    found = sum(want[r["vec_id"]] == r["component_id"] for r in linked)
    print("crowd recall", found, len(linked))
    assert found >= 0.99 * len(linked) if not exact else found == len(linked)
