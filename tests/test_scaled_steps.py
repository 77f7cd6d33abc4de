"""Steps that must not grow faster than their input: what they carry, shuffle and repeat."""

import pickle
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from threadweave import fixed_values as FV
from threadweave.functions import patterns as P
from threadweave.functions.tokens import fold_accents
from threadweave.operators import linear as L
from threadweave.operators import retrieval as R
from threadweave.operators import sampling as S
from threadweave.operators import tfidf as T


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_name_texts_by_numbers(spark, monkeypatch):
    train = spark.createDataFrame([("1", "lamp hums lamp", "a"), ("2", "lamp late", "a"), ("3", "parcel late", "b"), ("4", "parcel lost", "b")], "customer_tweet_id string, customer_text string, weak_intent string")
    scorer = L.fit_associations(train, min_df=1)
    keys = []
    original = L.term_frequencies
    monkeypatch.setattr(L, "term_frequencies", lambda df, key, *rest: keys.append(df.schema[key].dataType.simpleString()) or original(df, key, *rest))
    got = {r["customer_tweet_id"]: r["predicted_intent"] for r in scorer.predict(train.drop("weak_intent")).collect()}
    assert got == {"1": "a", "2": "a", "3": "b", "4": "b"} and keys == ["bigint"]


def test_portions_travel_without_zeros():
    weights = np.zeros((300, 9000))
    for k in range(300):
        weights[k, 30 * k: 30 * k + 30] = 0.5 + k
    portion = R._Portion([f"q{k}" for k in range(300)], [None] * 300, np.arange(9000, dtype=np.int64), weights)
    sent = pickle.dumps(portion)
    assert len(sent) < weights.nbytes / 50
    back = pickle.loads(sent)
    assert np.array_equal(back.weights, weights) and back.names == portion.names and np.array_equal(back.terms, portion.terms)


def test_only_characters_that_unfold_are_taken_one_by_one(spark):
    rows = spark.createDataFrame([("ﬁrst of…the ﬅ½ 한국 é",), ("ﬁ",), ("é plain",), ("",)], "t string")
    folded = rows.select(fold_accents("t").alias("f"))
    assert "split(translate" in plan_of(folded) and ", , -1)" not in plan_of(folded)
    assert [r["f"] for r in folded.collect()][1:] == ["fi", "e plain", ""]


def test_candidates_are_found_once_for_their_summary(spark):
    pairs = spark.createDataFrame([(f"c{k}", f"a{k}", t, "r") for k, t in enumerate(["battery life is bad", "refund me", "no sim card", "hello"] * 5)], "customer_tweet_id string, agent_tweet_id string, customer_text string, agent_text string")
    rows = S.annotation_candidates(pairs)
    summary = S.candidate_summary(rows)
    assert "RLIKE" not in plan_of(summary).upper()
    assert {(r["measure"], r["name"]): r["n"] for r in summary.collect()}["n_examples", "all"] == rows.count() == 20


def odd_texts(n=400):
    dice = random.Random(4)
    bits = ["battery", "dying", "ſim", "sim", "no", "Kernel", "İcloud", "icloud", "locked", "é", " ", "\u000b", " ", "́", "refund", "REFUND",
            "²", "٣", "ios", "11", "µ", "\n", " ", " ", " ", "wi-fi", "not", "’", "下", "how", "do", "i", "‍", "_", "%", "drop"]
    return ["".join(dice.choices(bits, k=dice.randint(0, 12))) for _ in range(n)] + [None, ""]


def test_screened_patterns_hit_where_plain_ones_do(spark):
    rows = spark.createDataFrame([(t,) for t in odd_texts()], "t string")
    for patterns in (None, FV.STRATIFY_PATTERNS, FV.THEME_PATTERNS, FV.DISCOVERY_PATTERNS):
        plain = P.hit_mask(P.strong_hits("t") if patterns is None else P.hits_of("t", patterns))
        got = P.with_hits(rows.withColumn("want", plain), "t", patterns).collect()
        assert all(r["want"] == r["hit_mask"] for r in got) and any(r["want"] for r in got)


def test_screen_rules_out_most_patterns():
    names = [p for _, p in FV.STRATIFY_PATTERNS]
    masks = P.possible_hits(pa.array(["ein Wörterbuch", "battery life", None, "́"]), names).to_pylist()
    assert masks[0] == masks[2] == 0 and masks[1] == 1 and masks[3] == (1 << len(names)) - 1


def char_counts(text):
    return Counter(g for w in text.lower().split() for g in T.grams_of_word(f" {w} "))


def word_counts(text):
    words = [w for w in text.lower().split() if len(w) > 1]
    return Counter(words + [" ".join(p) for p in zip(words, words[1:])])


def test_terms_are_counted_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(T, "WORDS_HELD", 50)
    dice = random.Random(9)
    texts = {k: " ".join(dice.choices("aaaa the lamp hums tea x again of".split(), k=dice.randint(0, 40))) for k in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "k int, t string").repartition(3).cache()
    for analyzer, rule in (("char", char_counts), ("word", word_counts)):
        found = T.term_frequencies(rows, "k", "t", analyzer)
        assert "Aggregate" not in plan_of(found)
        got = {(r["k"], r["term"]): r["tf"] for r in found.collect()}
        assert got == {(k, term): n for k, t in texts.items() for term, n in rule(t).items()}
    both = {(r["k"], r["term"]): r["tf"] for r in T.term_frequencies(rows, "k", "t", "word+char").collect()}
    assert both == {(k, p + term): n for k, t in texts.items() for p, rule in (("w:", word_counts), ("c:", char_counts)) for term, n in rule(t).items()}


def test_character_counts_of_rows_with_one_key_are_added(spark):
    rows = spark.createDataFrame([(1, "lamp"), (1, "lamp tea"), (None, "tea"), (None, "tea"), (2, "tea"), (3, None)], "k int, t string")
    got = {(r["k"], r["term"]): r["tf"] for r in T.term_frequencies(rows, "k", "t", "char").collect()}
    want = Counter()
    for k, text in ((1, "lamp"), (1, "lamp tea"), (None, "tea"), (None, "tea"), (2, "tea")):
        want.update({(k, g): n for g, n in char_counts(text).items()})
    assert got == dict(want)
