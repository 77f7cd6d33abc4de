"""Wording of agents, shared lines and ranked search against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadweave.llm import line_dedup, ranked_search, source_divergence
from threadweave.llm.byte_terms import LETTERS, LETTERS_AND_DIGITS, terms_of
from threadweave.llm.cuckoo import CuckooFilter

LETTER_TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORDS = ["Refund", "order", "straße", "late,", "don't", "IPHONE7", "ok", "Ünder", "naïve", "reset", "the", "the", "app"]


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def slow_terms(text, pattern):
    return pattern.findall(small(text or ""))


@pytest.mark.parametrize("table,pattern", [(LETTERS, LETTER_TERM), (LETTERS_AND_DIGITS, WORD_TERM)])
def test_terms_equal_the_pattern(table, pattern):
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(0x100)] + ["İ", "ſ", "𝒳", " ", "ẞ"]
    for text in ["", None, "A\x00b", *("".join(rng.choices(alphabet, k=200)) for _ in range(50))]:
        got = [t.decode() for t in terms_of(text.encode() if text else None, table)]
        assert got == slow_terms(text, pattern)


# ---- wording of agents

REPLIES = "weak_intent string, agent_author_id string, agent_text string, term string, tf string"


def slow_audit(rows, min_posts, smoothing=5, most=50):
    docs = [(a or "", b or "", Counter(slow_terms(t, LETTER_TERM))) for a, b, t in rows]
    out = []
    for intent in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == intent]
        found = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t, n in found.items() if n >= min_posts)
        authors = {d[1] for d in mine}

        def shares(of):
            counts = Counter()
            for d in of:
                counts.update({t: n for t, n in d[2].items() if t in kept})
            total = sum(counts.values()) + smoothing * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + smoothing) // total for t in kept}, counts

        whole, _ = shares(mine)
        own = {a: shares([d for d in mine if d[1] == a]) for a in authors}
        for a in authors:
            p, counts = own[a]
            pair = [(b, sum(abs(p[t] - own[b][0][t]) for t in kept)) for b in authors if b != a]
            term = [(t, p[t] - whole[t]) for t in kept if counts[t] and p[t] > whole[t]]
            for part, items, top in (("pair", pair, len(pair)), ("term", term, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(intent, a, part, item, value, k) for k, (item, value) in enumerate(items[:top], 1)]
    return sorted(out)


def replies(n=400, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice(["refund", "delay", None, ""]), rng.choice(["A", "A", "A", "b", "ü", None]), " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for _ in range(n)]
    return rows + rows[:5] + [("lonely", "A", None), ("lonely", "b", " 12 "), ("single", "A", "word"), ("delay", "A", "the long text " * 20_000)]


@pytest.mark.parametrize("min_posts,entries,block,stripe", [(30, 200_000, 1024, 256), (2, 3, 4, 2), (10_000, 200_000, 1024, 256)])
def test_audit_equals_the_plain_version(posts, monkeypatch, min_posts, entries, block, stripe):
    monkeypatch.setattr(source_divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(source_divergence, "STRIPE", stripe)
    rows = replies()
    table = posts([(*r, "x", "y") for r in rows], REPLIES).repartition(3)
    got = source_divergence.audit_agent_wording(table, min_posts=min_posts, most_terms=4)
    assert got.columns == ["weak_intent", "agent_author_id", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow_audit(rows, min_posts, most=4)


def test_audit_sums_survive_being_handed_on_early(monkeypatch):
    import pyarrow as pa

    rows = [("i", "a", b"x y z x"), ("i", "b", b"x"), ("i", "a", b"x q"), ("i", "a", None)] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], ["intent", "author", "text"])
    for entries in (1, 3, 1000):
        monkeypatch.setattr(source_divergence, "ENTRIES", entries)
        total = defaultdict(lambda: np.zeros(2, int))
        for out in source_divergence._count_terms(iter([batch, batch])):
            for r in out.to_pylist():
                total[r["author"], r["term"]] += [r["tf"], r["df"]]
        assert {k: tuple(v) for k, v in total.items()} == {
            ("a", b"x"): (30, 20), ("a", b"y"): (10, 10), ("a", b"z"): (10, 10), ("a", b"q"): (10, 10), ("a", None): (0, 0),
            ("b", b"x"): (10, 10), ("b", None): (0, 0),
        }


def test_audit_of_an_empty_table(posts):
    assert source_divergence.audit_agent_wording(posts([], REPLIES)).collect() == []


def test_shares_stay_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 9_000_000_000_000_001, 9_100_000_000_000_003
    row = spark.range(1).select(source_divergence._share(F.lit(n), F.lit(total), F.lit(7), 5).alias("p")).first()
    assert row["p"] == 1 + 1_000_000_000 * (n + 5) // (total + 35)


# ---- lines

def slow_lines(rows, min_length=10):
    def key(line):
        return small(line.strip(" \t\n\x0b\x0c\r"))

    order = lambda i: (i is None, i if i is not None else 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_length or len(holders[key(x)]) < 2 or min(holders[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lined(n=150, seed=8):
    rng = random.Random(seed)
    shared = [f"shared line number {k} of äll" for k in range(30)] + ["short", "", "exactly10!", "nine char"]
    rows = []
    for k in range(n):
        own = [f"own line {k} {j} text" for j in range(rng.randint(0, 4))]
        lines = own + [rng.choice(["", " ", "\t"]) + (rng.choice(shared).upper() if rng.random() < 0.1 else rng.choice(shared)) + rng.choice(["", "\r", "  "]) for _ in range(rng.randint(0, 6))]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    rows += [rows[3], rows[4], (7, "shared line number 1 of äll\nanother text of seven"), (None, rows[5][1]), (None, "null line one two"), (None, "null line one two")]
    return rows + [(900, None), (901, ""), (902, "\n"), (903, "a very long line " * 30_000), (904, "a very long line " * 30_000), (905, "many lines here\n" * 20_000)]


LINED = "tweet_id bigint, text string, key string, post string"


def table_of(posts, rows):
    return posts([(*r, "x", "y") for r in rows], LINED).repartition(3)


def dropped(table, index):
    return sorted(map(tuple, line_dedup.drop_repeated_lines(table, index).collect()), key=repr)


@pytest.mark.parametrize("keys_per_shard", [65_536, 40])
def test_lines_equal_the_plain_version(posts, monkeypatch, keys_per_shard):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", keys_per_shard)
    rows = lined()
    table = table_of(posts, rows)
    index = line_dedup.insert_posts(None, table)
    assert dropped(table, index) == slow_lines(rows)
    assert index.counts.count() < index.references.select("key").distinct().count()


def test_posts_go_in_and_out(posts, monkeypatch):
    """After any insertions and deletions the result is that of the posts that are in."""
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 60)
    rows = lined(90)
    first, second, third = rows[::3], rows[1::3], rows[2::3]
    index = line_dedup.insert_posts(None, table_of(posts, first))
    index = line_dedup.insert_posts(index, table_of(posts, second))
    assert dropped(table_of(posts, first + second), index) == slow_lines(first + second)
    gone = {r[0] for r in first[:20]} | {905, 77_777}
    index = line_dedup.delete_posts(index, posts([(i, "x") for i in gone] + [(None, "x")], "tweet_id bigint, key string"))
    left = [r for r in first + second if r[0] not in gone]
    assert dropped(table_of(posts, left), index) == slow_lines(left)
    # Filters hold one fingerprint per line that is left, and take posts in again.
    assert sum(len(CuckooFilter.from_bytes(r["filter"])) for r in index.filters.collect()) == index.references.select("key").distinct().count()
    back = [r for r in first if r[0] in gone] + third
    index = line_dedup.insert_posts(index, table_of(posts, back))
    assert dropped(table_of(posts, left + back), index) == slow_lines(left + back)
    assert sum(len(CuckooFilter.from_bytes(r["filter"])) for r in index.filters.collect()) == index.references.select("key").distinct().count()


def test_lines_of_empty_tables(posts):
    empty = posts([], LINED)
    index = line_dedup.insert_posts(None, empty)
    assert line_dedup.drop_repeated_lines(empty, index).collect() == []
    rows = [(1, "a line of some length"), (2, "a line of some length")]
    index = line_dedup.insert_posts(index, table_of(posts, rows))
    assert dropped(table_of(posts, rows), index) == slow_lines(rows)


def test_filter_never_misses_and_gives_back():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    others = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    for table in (CuckooFilter.for_keys(len(keys)), CuckooFilter(1 << 13)):  # the second is too small: the rest is stashed
        own = keys if len(table.table) > 1 << 13 else keys[:33_000]
        for part in np.array_split(own, 7):
            table.insert(part)
        assert len(table) == len(own) and table.contains(own).all() and table.contains(others).mean() < 0.002
        table.delete(own[:20_000])
        read = CuckooFilter.from_bytes(table.to_bytes())
        assert read.contains(own[20_000:]).all() and read.contains(own[:20_000]).mean() < 0.002 and len(read) == len(own) - 20_000
    assert len(table.stash) and CuckooFilter.for_keys(0).contains(keys[:3]).tolist() == [False] * 3
    with pytest.raises(ValueError):
        CuckooFilter(3)


# ---- ranked search

PAIRS = "customer_tweet_id bigint, customer_text string, bag string, hash string"
QUERIES = "query_id bigint, text string, term string"


def slow_search(queries, rows, k):
    bags = [(i, Counter(slow_terms(t, WORD_TERM))) for i, t in rows]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_posts, n_all = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for q, text in queries:
        scores = []
        for i, bag, n in bags:
            m = 25 + (75 * n * n_posts) // n_all
            score = sum(
                math.floor(1000 * math.log((2 * n_posts + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in slow_terms(text, WORD_TERM) if bag[t]
            )
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def messages(n=300, seed=6):
    rng = random.Random(seed)
    words = WORDS + [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 15)))) for k in range(n)]
    rows += [(n + k, rows[k % 4][1].upper()) for k in range(60)]  # groups of equal bags
    return rows + rows[:3] + [(None, rows[5][1]), (None, rows[5][1]), (997, None), (998, " .,- "), (999, "refund order w1 " * 30_000)]


ASKED = [(1, "where is my ORDER refund refund w1"), (2, "naïve w3 w3 w9"), (2, "repeated id: w7"), (3, None), (4, "..."), (None, "w11 app"), (5, "unknownword"), (6, "the"), (7, " ".join(f"w{k}" for k in range(40)))]


@pytest.mark.parametrize("k,terms", [(10, 32_768), (3, 5), (1, 32_768)])
def test_search_equals_the_plain_version(posts, monkeypatch, k, terms):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", terms)
    rows = messages()
    table = posts([(*r, "x", "y") for r in rows], PAIRS).repartition(3)
    asked = posts([(*q, "x") for q in ASKED], QUERIES)
    got = ranked_search.search_messages(asked, table, k)
    assert got.columns == ["query_id", "rank", "customer_tweet_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow_search(ASKED, rows, k)


@pytest.mark.parametrize("cells,exact", [(1 << 22, 1 << 53), (16, 1 << 53), (1 << 22, 1)])
def test_scores_are_the_same_in_doubles_and_integers_and_in_any_part(monkeypatch, cells, exact):
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    monkeypatch.setattr(ranked_search, "EXACT", exact)
    block = ranked_search.QuestionBlock(["a", "b"], {b"x": 0, b"y": 1, b"z": 2}, [np.array([0, 2]), np.array([1])], [np.array([2, 1]), np.array([1])])
    scorer = ranked_search._Scorer(block, np.array([500, 700, 11]))
    assert scorer.kind == (np.float64 if exact > 1 else np.int64)
    bags = [np.array([[0, 2], [3, 1]], "<u4").tobytes(), np.array([[1], [2]], "<u4").tobytes()]
    part = lambda tf, m: 1_000_000_000 * tf // (1000 * tf + 8 * m)
    assert scorer.scores(bags, np.array([40, 90])).tolist() == [[2 * 500 * part(3, 40) + 11 * part(1, 40), 0], [0, 700 * part(2, 90)]]


def test_search_of_empty_tables(posts):
    asked, rows = posts([(1, "order", "x")], QUERIES), posts([(1, "order", "x", "y")], PAIRS)
    for q, p in ((asked.limit(0), rows), (asked, rows.limit(0)), (asked, posts([(1, None, "x", "y")], PAIRS))):
        assert ranked_search.search_messages(q, p).collect() == []
    with pytest.raises(ValueError):
        ranked_search.search_messages(asked, rows, 0)
