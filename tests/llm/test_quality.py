"""Rules with posterior verdicts, and nearest-neighbour scores."""

import random
import re

import numpy as np
import pytest

from threadweave.llm import quality_neighbours as QN
from threadweave.llm import quality_rules as QR

WORDS = "the order came late and my account still shows it as open so please tell me when a refund will arrive".split()


def good_text(rng, n=90):
    words = [rng.choice(WORDS) + (rng.choice("abcdefgh") * rng.randint(0, 3)) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


def bad_text(rng, n=90):
    return " ".join(w.strip(".") + rng.choice(["$$$", "###", "***"]) for w in good_text(rng, n).split())


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k: k + 3]) for k in range(len(words) - 2)]
    repeated = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in (k, k + 1, k + 2)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(repeated),
    )


CASES = [
    None, "", "   \n\t", "one", "a b", "a b c", "a b c a b c", "x x x x x", "l1\nl1\n\n\nl2\r\nl1", "é ñ $ | 🙂🙂 <b>",
    "a b c\x0bd\x1ce", "p q r s p q r t p q r", "same line here now\n" * 40, "Hello!! " * 200, "HELP!! NOW!! " * 3,
]


def test_counts_equal_the_plain_ones(posts):
    rng = random.Random(1)
    texts = CASES + [" ".join(rng.choices("abcd", k=rng.randint(0, 40))) for _ in range(60)] + [good_text(rng, 3000)[:9000]]
    got = QR.score_post_quality(posts([(str(k), t, 7) for k, t in enumerate(texts)], "tweet_id string, text string, n_words int"))
    for r in got.collect():
        counts = slow_counts(texts[int(r["tweet_id"])])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])


def test_posterior_separates_junk_and_treats_equal_texts_alike(posts):
    rng = random.Random(3)
    rows = [(f"g{k}", good_text(rng)) for k in range(150)] + [(f"b{k}", bad_text(rng)) for k in range(20)]
    rows += [(None, rows[0][1]), ("g0", rows[0][1])]
    got = QR.score_post_quality(posts(rows)).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] == (not (r["tweet_id"] or "g").startswith("b")) for r in got)


def test_estimate_recovers_planted_accuracies():
    rng = random.Random(0)
    truth = [rng.random() < 0.8 for _ in range(20_000)]
    chance = [(0.95, 0.1), (0.9, 0.2), (0.97, 0.3), (0.9, 0.05)]  # good votes among good and among bad
    counted = {}
    for good in truth:
        votes = tuple(1 if rng.random() < (g if good else b) else -1 for g, b in chance)
        counted[votes] = counted.get(votes, 0) + 1
    share, tables = QR.fit_votes(sorted(counted.items()))
    assert share == pytest.approx(0.8, abs=0.03)
    for table, (g, b) in zip(tables, chance):
        assert table[1][0] == pytest.approx(g, abs=0.05) and table[1][1] == pytest.approx(b, abs=0.08)
    assert QR.fit_votes([])[1] == []


def test_rules_on_empty_table(posts):
    assert QR.score_post_quality(posts([])).collect() == []


def test_rules_plan_runs_no_python(posts):
    plan = QR.score_post_quality(posts([("1", "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def labelled(posts):
    rng = random.Random(11)
    rows = [(f"g{k:03d}", good_text(rng, rng.randint(5, 150))) for k in range(160)]
    rows += [(f"b{k:03d}", bad_text(rng, rng.randint(5, 150))) for k in range(60)]
    return rows


def test_neighbours_tell_held_out_posts_apart(posts, labelled):
    table = posts([(*r, "x") for r in labelled], "tweet_id string, text string, label string")
    labels = posts([(i, int(i[0] == "g")) for i, _ in labelled if int(i[1:]) % 4] + [(None, 1), ("g001", None)], "tweet_id string, quality int")
    model = QN.fit_post_quality(table, labels)
    got = {r["tweet_id"]: r["score"] for r in QN.score_post_neighbours(table, model).collect()}
    assert all((got[i] >= 0.3) == (i[0] == "g") for i, _ in labelled if int(i[1:]) % 4 == 0)
    assert all(0 <= s <= 1 for s in got.values())


def test_scores_equal_brute_force(labelled):
    texts, labels = [t for _, t in labelled], [int(i[0] == "g") for i, _ in labelled]
    model = QN.fit_neighbours(texts[::2], labels[::2], k=5)
    vectors, known, balance = model.embed(texts), model.vectors, model.balance()
    for k in range(0, len(texts), 17):
        cosines = np.array([max(0.0, min(1.0, float(vectors[k] @ v))) for v in known])
        near = cosines >= np.sort(cosines)[-5]
        votes = np.where(near, cosines, 0) ** model.sharpness * balance
        assert model.scores([texts[k]])[0] == pytest.approx((votes @ model.labels) / votes.sum(), abs=1e-9)


def test_neighbours_rows_and_bounds(posts, labelled):
    model = QN.fit_neighbours([t for _, t in labelled[:20]], [1] * 10 + [0] * 10)
    rows = [("a", None, 1.0), ("b", "", 2.0), (None, "please tell me", 3.0), ("a", None, 1.0), ("long", "refund " * 40_000, 4.0)]
    got = QN.score_post_neighbours(posts(rows, "tweet_id string, text string, score double"), model).collect()
    assert len(got) == 5 and got[0]["score"] == pytest.approx(0.5) == got[1]["score"] and got[0] == got[3]
    table, labels = posts(labelled), posts([(i, 1) for i, _ in labelled], "tweet_id string, quality int")
    assert len(QN.fit_post_quality(table, labels, most_labelled=30).labels) == 30
    empty = QN.fit_post_quality(posts([]), posts([], "tweet_id string, quality int"))
    assert [r["score"] for r in QN.score_post_neighbours(posts([("1", "any")]), empty).collect()] == [0.5]
    assert QN.score_post_neighbours(posts([]), empty).collect() == []


def test_bounds_of_the_fit_hold_whatever_repeats(posts, labelled):
    rows = [("hot", f"please tell me {k} when") for k in range(5000)] + [("long", "x " * 30_000)] + labelled[:40]
    table = posts(rows)
    labels = posts([("hot", 1), ("hot", 1), ("long", 0)] + [(i, int(i[0] == "g")) for i, _ in labelled[:40]], "tweet_id string, quality int")
    assert len(QN.fit_post_quality(table, labels, most_labelled=10).labels) == 10
    assert len(QN.fit_post_quality(table, labels).labels) == 42
    assert len(QN.fit_post_quality(table, labels, most_bytes=300_000).labels) == 41  # the long text is left out
    total = sum(len(t) for _, t in labelled[:40])
    some = QN.fit_post_quality(table, labels.filter("tweet_id like 'g%'"), most_bytes=16_000)
    assert 0 < len(some.labels) < 40 and total > 16_000


def test_products_by_rows_equal_those_of_the_whole_matrix():
    rng = random.Random(4)
    texts = [good_text(rng, rng.randint(0, 40)) for _ in range(600)]
    places = {t: k for k, t in enumerate(sorted({t for x in texts for t in QN.text_terms(x)})[:300])}
    idf = np.linspace(1, 2, len(places))
    whole = np.zeros((len(texts), len(places)))
    for r, x in enumerate(texts):
        for term, w in QN.text_terms(x).items():
            if term in places:
                whole[r, places[term]] = w * idf[places[term]]
    rows, base = QN._SparseRows(texts, places, idf), np.random.default_rng(1).standard_normal((len(places), 5)).astype(np.float32)
    assert np.allclose(rows.times(base), whole @ base, atol=1e-4)
    assert np.allclose(rows.transposed_times_itself_times(base), whole.T @ (whole @ base), rtol=1e-3, atol=1e-2)
