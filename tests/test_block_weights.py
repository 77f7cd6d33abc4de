"""Weights of words are worked out where the text is read; only rows that share a key meet in a shuffle."""

import math
import random
from collections import Counter, defaultdict

import pytest

from threadweave.operators import retrieval as R
from threadweave.operators.tfidf import fit_tfidf


def word_counts(text):
    words = [w for w in (text or "").lower().split() if len(w) > 1]
    return Counter(words + [" ".join(p) for p in zip(words, words[1:])])


def by_hand(rows, min_df):
    counts = [(k, word_counts(t)) for k, t in rows]
    df = Counter(t for _, c in counts for t in c)
    raw = [(k, t, n * (math.log((1 + len(rows)) / (1 + df[t])) + 1)) for k, c in counts for t, n in c.items() if df[t] >= min_df]
    length = defaultdict(float)
    for k, _, r in raw:
        length[k] += r * r
    return sorted((str(k), t, pytest.approx(r / math.sqrt(length[k]), abs=1e-12)) for k, t, r in raw)


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("chars,min_df", [(1 << 22, 2), (300, 1)])
def test_weights_equal_those_by_hand(spark, monkeypatch, chars, min_df, shared):
    monkeypatch.setattr(R, "BLOCK_CHARS", chars)
    dice = random.Random(6)
    rows = [(k, " ".join(dice.choices("the lamp hums tea Parcel late again of é x été".split(), k=dice.randint(0, 25)))) for k in range(70)] + [(70, None), (71, "")]
    if shared:
        rows += [(3, "lamp tea tea"), (3, "lamp tea tea"), (None, "tea again"), (None, "hums lamp")]
    plain = [(k, (t or "").replace("é", "e")) for k, t in rows]
    weights = fit_tfidf(spark.createDataFrame(rows, "k int, t string").repartition(3), "k", "t", min_df=min_df)[1]
    got = sorted((str(r["k"]), r["term"], r["w"]) for r in weights.collect())
    assert weights.columns == ["k", "term", "w"] and got == by_hand(plain, min_df)
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert shared or not ("Window" in plan or "Join" in plan or "Aggregate" in plan)


def test_no_texts_have_no_weights(spark):
    for rows in ([], [(1, "")], [(1, None)]):
        vocab, weights = fit_tfidf(spark.createDataFrame(rows, "k int, t string"), "k", "t")
        assert weights.collect() == [] and weights.columns == ["k", "term", "w"] and vocab.collect() == []
