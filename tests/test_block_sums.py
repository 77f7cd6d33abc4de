"""Linear scores and coefficients without a shuffle of terms by text, whatever keys and vocabularies are."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tests.test_linear import ASKED, SCHEMA, rows_of
from tests.test_retrieval import grams
from threadweave.operators import classifiers as C
from threadweave.operators import linear as L
from threadweave.operators import retrieval as R


def by_row(df):
    return sorted((str(r["customer_tweet_id"]), r["predicted_intent"], r["classifier_confidence"], *r["probabilities"].values()) for r in df.collect())


@pytest.mark.parametrize("chars", [1 << 22, 200])
def test_a_table_too_large_to_send_scores_alike(spark, monkeypatch, chars):
    scorer = L.fit_associations(spark.createDataFrame(rows_of(), SCHEMA))
    asked = spark.createDataFrame(ASKED + [(f"{k}", t, None, "e") for k, t, _, _ in rows_of(90, 7)], SCHEMA).repartition(3)
    sent = by_row(scorer.predict(asked))
    monkeypatch.setattr(L, "SENT_TERMS", -1)
    monkeypatch.setattr(R, "BLOCK_CHARS", chars)
    monkeypatch.setattr(L, "term_frequencies", None)
    for a, b in zip(sent, by_row(scorer.predict(asked)), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
    assert scorer.predict(asked.limit(0)).collect() == []
    none = L.LinearScorer(scorer.labels, scorer.intercepts, scorer.vocab.limit(0), scorer.coefficients.limit(0))
    assert {r["predicted_intent"] for r in none.predict(asked).collect()} == {scorer.labels[scorer.intercepts.index(max(scorer.intercepts))]}


def test_associations_with_repeated_and_missing_keys(spark, monkeypatch):
    """Each text of a key counts for the label of each row of it; without a key only for how many rows have a term."""
    rows = rows_of(60) + [("003", "lamp refund twice", "bill", "x"), ("003", "lamp box", "lamp", "x"), (None, "refund box hums", "bill", "x"), ("900", None, "lamp", "x"), ("901", "box", None, "x")]
    scorer = L.fit_associations(spark.createDataFrame(rows, SCHEMA))
    used = [(k, Counter(grams(t)), label) for k, t, label, _ in rows if t is not None and label is not None]
    df = Counter(t for _, c, _ in used for t in c)
    n = defaultdict(int)
    for k, c, _ in used:
        for other, _, label in used:
            if k is not None and k == other:
                for t, m in c.items():
                    if df[t] >= 2:
                        n[t, label] += m
    of_term, of_label = Counter(), Counter()
    for (t, label), m in n.items():
        of_term[t] += m
        of_label[label] += m
    want = {(t, label): pytest.approx(L.SHARPNESS * math.log(1 + m * sum(n.values()) / (of_term[t] * of_label[label])), abs=1e-9) for (t, label), m in n.items()}
    assert {(r["term"], r["label"]): r["weight"] for r in scorer.coefficients.collect()} == want
    assert {r["term"]: r["df"] for r in scorer.vocab.collect()} == {t: m for t, m in df.items() if m >= 2}


def test_texts_are_scored_once_and_meet_their_sums_by_digest(spark):
    dice = random.Random(1)
    rows = spark.createDataFrame(rows_of(80), SCHEMA)
    asked = spark.createDataFrame([(f"o{k}", " ".join(dice.choices("lamp hums refund twice box late".split(), k=5)), None, "e") for k in range(30)], SCHEMA)
    second, added = C.self_train(rows, asked, threshold=0.3, fit=L.fit_associations)
    assert "Join" not in added._jdf.queryExecution().optimizedPlan().toString() and added.count()
    joins = [line for line in second.predict(asked).drop("customer_text")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("_text" in line for line in joins)
