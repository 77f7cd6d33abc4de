import math
import random
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadweave.functions.tokens import char_grams, fold_accents
from threadweave.operators import retrieval as R
from threadweave.operators.tfidf import fit_tfidf, term_frequencies

PAIRS = [
    ("k1", "s1", "the lamp in the hall hums at night", "Is it the round one?"),
    ("k2", "s2", "two parcels arrived, both empty", "We send them again."),
    ("k3", "s3", "the kettle leaks at the lid", "Please send a picture."),
    ("k4", "s4", "a lamp in the kitchen hums", "Unplug it, then plug it in."),
    ("k5", "s5", "my lamp hums at night and flickers in the hall", "A fitter will come."),
    ("k6", "s6", "both parcels were empty, two of two", "Sorry about that."),
    ("k7", "s7", " \t ", "nothing was asked"),
]
SCHEMA = "customer_tweet_id string, agent_tweet_id string, customer_text string, agent_text string"


def grams(text):
    words = re.findall(r"\b\w\w+\b", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(docs, queries, k):
    tf = {d: Counter(grams(t)) for d, t in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items() if n >= 2}

    def unit(counts):
        raw = {t: n * idf[t] for t, n in counts.items() if t in idf}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / size for t, v in raw.items()}

    vectors = {d: unit(c) for d, c in tf.items()}
    out = {}
    for q, text in queries.items():
        v = unit(Counter(grams(text)))
        scored = [(-round(sum(w * vec.get(t, 0.0) for t, w in v.items()), 12), d) for d, vec in vectors.items()]
        out[q] = [(d, round(-s, 9)) for s, d in sorted(scored)[:k]]
    return out


def found(spark, docs, queries, k):
    pairs = spark.createDataFrame([(d, "a", t, "r") for d, t in docs.items()], SCHEMA)
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    rows = R.retrieve_similar(asked, R.build_index(pairs), k).orderBy("query_id", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["customer_tweet_id"], round(r["similarity_score"], 9) + 0.0))
    return out


@pytest.mark.parametrize("portion,terms,cells", [(512, 32_768, 1 << 22), (3, 32_768, 16), (512, 9, 1 << 22)])
def test_top_k_equals_brute_force_with_hot_words(spark, monkeypatch, portion, terms, cells):
    for name, value in (("PORTION", portion), ("PORTION_TERMS", terms), ("CELLS", cells)):
        monkeypatch.setattr(R, name, value)
    dice = random.Random(3)
    rare = [f"w{i}" for i in range(120)]
    docs = {
        f"{i:03d}": " ".join(["the"] * dice.randint(1, 4) + ["and", "of"][: dice.randint(0, 2)] + dice.choices(rare, k=dice.randint(2, 12)))
        for i in range(150)
    }
    queries = {f"q{i}": "the and " + " ".join(dice.choices(rare, k=6)) for i in range(12)}
    queries |= {"hot": "the the and", "one": "w5", "none": "unseen words only", "same": docs["007"]}
    assert found(spark, docs, queries, 5) == brute_force(docs, queries, 5)


def test_index_round_trip_and_reserved_ids(spark, tmp_path):
    pairs = spark.createDataFrame(PAIRS, SCHEMA)
    index = R.build_index(pairs, spark.createDataFrame([("k1",)], "customer_tweet_id string"))
    assert index.meta.first()["n_documents"] == 5
    R.save_index(index, str(tmp_path / "index"))
    loaded = R.load_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([("q", "which lamp hums at night in the hall"), ("z", "zebra"), ("b", "\n")], "query_id string, text string")
    rows = R.retrieve_similar(asked, loaded, 3).orderBy("query_id", "rank").collect()
    assert [r["customer_tweet_id"] for r in rows if r["query_id"] == "q"][:2] == ["k5", "k4"]
    assert all(0 <= r["similarity_score"] <= 1 + 1e-6 for r in rows)
    assert [(r["customer_tweet_id"], r["similarity_score"]) for r in rows if r["query_id"] == "z"] == [("k2", 0.0), ("k3", 0.0), ("k4", 0.0)]
    assert not [r for r in rows if r["query_id"] == "b"]
    arrays = {r["query_id"]: r["evidence"] for r in R.evidence_arrays(R.retrieve_similar(asked, loaded, 9)).collect()}
    assert len(arrays["q"]) == 5 and arrays["q"][0]["agent_text"] == "A fitter will come."
    with pytest.raises(ValueError):
        R.retrieve_scores(asked, loaded, 0)
    R.save_index(R.RetrievalIndex(loaded.docs, loaded.vocab.drop("idf"), loaded.vectors, loaded.meta), str(tmp_path / "other"))
    with pytest.raises(ValueError, match="idf"):
        R.load_index(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no support pairs"):
        R.build_index(pairs.filter("customer_tweet_id = 'k7'"))


def test_a_message_never_finds_itself(spark):
    pairs = spark.createDataFrame([*PAIRS, ("k1", "s9", PAIRS[0][2], "A second answer."), ("k0", "s0", PAIRS[0][2], "Same words.")], SCHEMA)
    asked = pairs.select(F.concat_ws("/", "customer_tweet_id", "agent_tweet_id").alias("query_id"), F.col("customer_text").alias("text"), "customer_tweet_id")
    rows = R.retrieve_similar(asked, R.build_index(pairs, min_df=1), 3, own="customer_tweet_id").collect()
    assert all(r["query_id"].split("/")[0] != r["customer_tweet_id"] for r in rows)
    assert {sum(r["query_id"] == q for r in rows) for q in {r["query_id"] for r in rows}} == {3}
    best = {r["query_id"]: (r["customer_tweet_id"], round(r["similarity_score"], 9)) for r in rows if r["rank"] == 1}
    assert best["k1/s1"] == best["k1/s9"] == ("k0", 1.0) and best["k0/s0"] == ("k1", 1.0)


def test_equal_common_questions_are_scored_once(spark):
    dice = random.Random(8)
    pairs = spark.createDataFrame(
        [(f"{k:04d}", "a", " ".join(["thank", "you", "so", *dice.choices(["much", "all", "again", "now"], k=3)]), "r") for k in range(600)], SCHEMA)
    index = R.build_index(pairs)
    asked = spark.createDataFrame([(f"q{k}", "thank you so much all") for k in range(100)], "query_id string, text string")
    asked_of = []
    original = R._portions
    R._portions = lambda terms: asked_of.extend(original(terms)) or asked_of
    try:
        rows = R.retrieve_scores(asked, index, 4).collect()
    finally:
        R._portions = original
    assert len(rows) == 400 and len({(r["doc_id"], r["rank"]) for r in rows}) == 4
    assert [len(p.names) for p in asked_of] == [1]


def test_blocks_that_cannot_reach_the_best_are_not_scored():
    dice = np.random.default_rng(5)
    known = np.arange(200, dtype=np.int64)
    docs = [np.sort(dice.choice(260, n, replace=False)) for n in np.sort(dice.integers(2, 90, 4000))]
    weights = [v / np.linalg.norm(v) for v in (dice.random(len(d)) + 0.1 for d in docs)]
    asked = np.zeros((20, 200))
    for row in asked:
        row[dice.choice(200, 5, replace=False)] = dice.random(5)
    ids = [f"{k:05d}{R.SEPARATOR}a" for k in range(len(docs))]
    search = R._Search(R._Portion([f"q{k}" for k in range(20)], [None] * 19 + ["00003"], known, asked), 3)
    for low in range(0, 4000, 700):
        part = slice(low, low + 700)
        search.take(ids[part], np.array([len(d) for d in docs[part]]), np.concatenate(docs[part]), np.concatenate(weights[part]))
    for q, row in enumerate(asked):
        full = [(-round(sum(row[t] * w for t, w in zip(d, v) if t < 200), 12), i) for d, v, i in zip(docs, weights, ids)]
        want = sorted(x for x in full if x[0] < 0 and not (q == 19 and x[1].startswith("00003")))[:3]
        assert [i for _, i in search.best[q]] == [i for _, i in want]
        assert [s for s, _ in search.best[q]] == pytest.approx([s for s, _ in want], abs=1e-11)
    assert search.n_scored < 0.4 * 20 * 4000


def test_vocabulary_and_weights(spark):
    docs = spark.createDataFrame([("a", "Café café noir"), ("b", "cafe NOIR x"), ("c", None)], "k string, t string")
    vocab, weights = fit_tfidf(docs, "k", "t")
    got = {r["term"]: (r["df"], round(r["idf"], 9)) for r in vocab.collect()}
    idf = round(math.log(4 / 3) + 1, 9)
    assert got == {"cafe": (2, idf), "noir": (2, idf), "cafe noir": (2, idf)}
    lengths = weights.groupBy("k").agg(F.sum(F.col("w") * F.col("w")).alias("l")).collect()
    assert {r["k"]: round(r["l"], 9) for r in lengths} == {"a": 1.0, "b": 1.0}


def test_char_grams_follow_the_sequential_rule(spark):
    def rule(text):
        out = []
        for word in text.lower().split():
            word = f" {word} "
            for n in range(2, 6):
                out += [word[i:i + n] for i in range(max(1, len(word) - n + 1))]
                if len(word) <= n:
                    break
        return out

    texts = ["a", "ab cd", "Hello  World\tx", "", "abcdefgh i"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["g"] for r in rows.orderBy("i").select(char_grams("t").alias("g")).collect()] == [rule(t) for t in texts]
    both = term_frequencies(rows, "i", "t", "word+char")
    assert both.filter("term = 'w:hello world'").count() == 1 and both.filter("term = 'c: a'").count() == 3


def test_accents(spark):
    rule = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    singles = [chr(c) for c in range(0x20, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    texts = ["Élan ñandú ½ ﬁn x² ß", "한국어 … ™ 𝐀𝟗 ㎏", "plain", "", "é\u0301e\u0301 🙂"] + ["a".join(singles[k: k + 200]) for k in range(0, len(singles), 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r["n"] for r in rows.select(fold_accents("t").alias("n")).collect()] == [rule(t) for t in texts]


def test_few_documents_are_scored_and_many_questions_travel_together():
    """Common words alone never lead to a score; the k best stay exact, own documents and equal scores included."""
    dice = np.random.default_rng(11)
    chance = 1 / np.arange(1, 4001)
    docs = [np.unique(dice.choice(4000, dice.integers(3, 40), p=chance / chance.sum())) for _ in range(3000)]
    docs[7], docs[9] = docs[5], docs[5]
    idf = np.log(3001 / (1 + np.bincount(np.concatenate(docs), minlength=4000))) + 1
    weights = [idf[d] / np.linalg.norm(idf[d]) for d in docs]
    ids = [f"{k // 2:05d}{R.SEPARATOR}{k % 2}" for k in range(len(docs))]
    questions = [5, *range(10, 2990, 5)]
    sizes = [len(docs[q]) for q in questions]
    known, place = np.unique(np.concatenate([docs[q] for q in questions]), return_inverse=True)
    asked = np.zeros((len(questions), len(known)))
    asked[np.repeat(np.arange(len(questions)), sizes), place] = np.concatenate([weights[q] for q in questions])
    search = R._Search(R._Portion([str(q) for q in questions], [f"{q // 2:05d}" for q in questions], known, asked), 3)
    for low in range(0, 3000, 1500):
        part = slice(low, low + 1500)
        search.take(ids[part], np.array([len(d) for d in docs[part]]), np.concatenate(docs[part]), np.concatenate(weights[part]))
    table = np.zeros((3000, 4000))
    for k, (d, w) in enumerate(zip(docs, weights)):
        table[k, d] = w
    for number, q in enumerate(questions):
        scores = np.round(table @ table[q], 12)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids) if s > 0 and not i.startswith(f"{q // 2:05d}"))[:3]
        assert [i for _, i in search.best[number]] == [i for _, i in want], q
    assert search.n_scored < 0.02 * len(questions) * 3000

    class Rows:
        def toLocalIterator(self):
            return iter([{"question": str(k), "own": None, "terms": [k, k + 1], "weights": [0.6, 0.8], "idfs": [2.0, 2.0]} for k in range(2000)])

    assert [len(p.names) for p in R._portions(Rows())] == [2000]


def test_pairs_that_come_twice_are_one_vector_whose_last_weight_counts():
    known = np.arange(4, dtype=np.int64)
    search = R._Search(R._Portion(["q"], [None], known, np.array([[0.6, 0.8, 0.0, 0.0]])), 2)
    search.take(["a\x1fx", "b\x1fx"], np.array([4, 2]), np.array([0, 1, 1, 0, 0, 2]), np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.5]))
    assert search.best == [[(-0.48, "a\x1fx"), (-0.3, "b\x1fx")]]
