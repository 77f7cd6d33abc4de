"""Scores by coefficient tables against fitted models and plain counts."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tests.test_retrieval import grams
from threadweave.operators import classifiers as C
from threadweave.operators import linear as L

SCHEMA = "customer_tweet_id string, customer_text string, weak_intent string, extra string"
TOPICS = {"lamp": "lamp hums flickers dim bulb", "parcel": "parcel late empty box courier", "bill": "bill twice charged refund price"}


def rows_of(n=120, seed=2):
    dice = random.Random(seed)
    shared = "my the is and again please help since today".split()
    out = []
    for k in range(n):
        topic = dice.choice(list(TOPICS) + ["lamp"])
        words = dice.choices(TOPICS[topic].split(), k=dice.randint(1, 4)) + dice.choices(shared, k=dice.randint(2, 6))
        dice.shuffle(words)
        out.append((f"{k:03d}", " ".join(words), topic, "x"))
    return out


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


ASKED = [("a", "the lamp hums again", None, "e"), ("b", "  refund twice please ", None, "e"), ("c", "zebra", None, None), ("d", " \t", None, "e"), ("e", None, None, "e"),
         ("a", "the lamp hums again", None, "e"), (None, "box box " * 20_000, None, "e")]


def test_a_fitted_model_scores_alike_as_tables(spark, train):
    model = C.fit_logreg(train)
    asked = spark.createDataFrame(ASKED, SCHEMA)
    want, got = model.predict(asked), L.scorer_of(model).predict(asked)
    assert got.columns == want.columns
    by_row = lambda df: sorted((str(r["customer_tweet_id"]), r["predicted_intent"], r["classifier_confidence"], sorted(r["probabilities"].items())) for r in df.collect())
    for a, b in zip(by_row(want), by_row(got), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)
        assert [x for x, _ in a[3]] == [x for x, _ in b[3]] and [x for _, x in a[3]] == pytest.approx([x for _, x in b[3]], abs=1e-9)
    with pytest.raises(ValueError):
        L.scorer_of(C.IntentModel("svm", "word", ["a"], None, None))


def test_associations_equal_plain_counts(spark, train):
    rows = rows_of()
    scorer = L.fit_associations(train)
    tf = [(label, Counter(grams(text))) for _, text, label, _ in rows]
    df = Counter(t for _, c in tf for t in c)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items() if n >= 2}
    n = defaultdict(int)
    for label, counts in tf:
        for t, m in counts.items():
            if t in idf:
                n[t, label] += m
    everything, of_term, of_label = sum(n.values()), Counter(), Counter()
    for (t, label), m in n.items():
        of_term[t] += m
        of_label[label] += m
    weight = {(t, label): L.SHARPNESS * math.log(1 + m * everything / (of_term[t] * of_label[label])) for (t, label), m in n.items()}
    assert {(r["term"], r["label"]): pytest.approx(r["weight"], abs=1e-9) for r in scorer.coefficients.collect()} == weight
    share = Counter(label for *_, label, _ in rows)
    labels = sorted(share)
    for r in scorer.predict(spark.createDataFrame(ASKED, SCHEMA)).collect():
        raw = {t: m * idf[t] for t, m in Counter(grams(r["customer_text"])).items() if t in idf}
        size = math.sqrt(sum(v * v for v in raw.values())) or 1
        scores = [math.log(share[x] / len(rows)) + sum(v / size * weight.get((t, x), 0) for t, v in raw.items()) for x in labels]
        most = max(scores)
        assert r["predicted_intent"] == labels[scores.index(most)]
        assert r["classifier_confidence"] == pytest.approx(1 / sum(math.exp(s - most) for s in scores), abs=1e-9)


def test_scorer_rows_and_errors(spark, train):
    scorer = L.fit_associations(train)
    got = scorer.predict(spark.createDataFrame(ASKED, SCHEMA)).collect()
    assert sorted(str(r["customer_tweet_id"]) for r in got) == ["None", "a", "a", "b", "c"]
    assert {r["customer_tweet_id"]: r["predicted_intent"] for r in got} == {"a": "lamp", "b": "bill", "c": "lamp", None: "parcel"}
    assert scorer.predict(train.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no labelled rows"):
        L.fit_associations(train.limit(0))
    held_out = scorer.predict(spark.createDataFrame(rows_of(80, 9), SCHEMA)).collect()
    assert sum(r["predicted_intent"] == r["weak_intent"] for r in held_out) >= 70
