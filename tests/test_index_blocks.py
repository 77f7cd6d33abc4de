"""The retrieval index counts in blocks: what is shuffled is a block's distinct terms, never the terms of every text."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_retrieval import SCHEMA, grams
from threadweave.operators import retrieval as R


def told_by_hand(docs, min_df):
    """Terms by document frequency, and every id's ``(df, tf)`` pairs and length; texts of one id are one vector."""
    counts = [(i, Counter(grams(t))) for i, t in docs]
    df = Counter(t for _, c in counts for t in c)
    known = {t: n for t, n in df.items() if n >= min_df}
    vectors = defaultdict(list)
    for i, c in counts:
        vectors[i] += [(known[t], n) for t, n in c.items() if t in known]
    idf = lambda n: math.log((1 + len(docs)) / (1 + n)) + 1
    return known, {i: (sorted(v), math.sqrt(sum((n * idf(d)) ** 2 for d, n in v))) for i, v in vectors.items() if v}


@pytest.mark.parametrize("chars,held,min_df", [(1 << 24, 1 << 23, 2), (60, 1 << 23, 2), (900, 20, 3), (1, 1, 1)])
def test_vectors_equal_those_by_hand(spark, monkeypatch, chars, held, min_df):
    monkeypatch.setattr(R, "BLOCK_CHARS", chars)
    monkeypatch.setattr(R, "TERMS_HELD", held)
    dice = random.Random(6)
    words = ["the", "of", "lamp", *(f"w{k}" for k in range(60))]
    docs = [(f"{k:03d}", " ".join(dice.choices(words, k=dice.choice([1, 3, 12, 40])))) for k in range(90)]
    docs += [("007", docs[7][1]), ("007", "another text of the lamp"), ("008", docs[8][1]), ("x", "?"), ("y", "of of of"), ("z", "é 한국 ßß the")]
    index = R.build_index(spark.createDataFrame([(d, "a", t, "r") for d, t in docs], SCHEMA).repartition(3), min_df=min_df)
    known, want = told_by_hand(docs, min_df)
    vocab = index.vocab.collect()
    assert sorted(r["df"] for r in vocab) == sorted(known.values()) and len({r["number"] for r in vocab}) == len(known)
    assert all(math.isclose(r["idf"], math.log((1 + len(docs)) / (1 + r["df"])) + 1) for r in vocab)
    df = {r["number"]: r["df"] for r in vocab}
    got = {r["doc_id"].split(R.SEPARATOR)[0]: (sorted(zip((df[t] for t in r["terms"]), r["tfs"])), r["size"]) for r in index.vectors.collect()}
    assert index.meta.first()["n_features"] == len(known) and got.keys() == want.keys()
    for i, (terms, size) in want.items():
        assert got[i][0] == terms and got[i][1] == pytest.approx(size, rel=1e-12)
    assert index.vectors.count() == len(want)


def test_a_block_sends_a_term_once(spark):
    dice = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    rows = [(0, k, f"d{k}", " ".join(dice.choices(words, k=80))) for k in range(400)]
    texts = spark.createDataFrame(rows, "block bigint, row bigint, doc_id string, customer_text string").coalesce(1)
    every, distinct = sum(len(set(grams(t))) for *_, t in rows), len({g for *_, t in rows for g in grams(t)})
    known = R._known_terms(texts, 3, 2).cache()
    answers = known.filter("block IS NOT NULL")
    # Eight bytes of rank and four of frequency a term, most of them zeros, which lie together.
    assert answers.agg(F.sum(F.length("found"))).first()[0] == 4 * distinct < 4 * every / 10
    plan = R._vectors(texts, answers, 3, 400)._jdf.queryExecution().executedPlan().toString()
    known.unpersist()
    final = plan[: plan.index("InMemoryRelation")] if "InMemoryRelation" in plan else plan
    assert final.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in final


def test_numbers_by_byte_planes():
    for numbers in (np.array([], np.uint64), np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)):
        assert np.array_equal(R._unpacked(R._packed(numbers)), numbers)
    assert R._packed(np.array([1, 2, 3]), "<u4") == bytes([1, 2, 3]) + bytes(9)


def test_portions_of_other_terms_are_an_error(spark):
    texts = spark.createDataFrame([(0, 0, "d0", "one lamp"), (0, 1, "d1", "two lamps")], "block bigint, row bigint, doc_id string, customer_text string").coalesce(1)
    known = R._known_terms(texts, 2, 1).filter("block IS NOT NULL")
    with pytest.raises(Exception, match="terms in a portion"):
        R._vectors(texts.filter("row = 0"), known, 2, 2).collect()


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_only_terms_asked_for_leave_the_vocabulary(spark, monkeypatch, most):
    docs = [(f"{k:02d}", "a", f"the lamp w{k % 9} hums w{k % 7} again", "r") for k in range(60)]
    index = R.build_index(spark.createDataFrame(docs, SCHEMA))
    asked = spark.createDataFrame([("q", "which lamp hums w3"), ("r", "w5 w5 unseen")], "query_id string, text string")
    monkeypatch.setattr(R, "BROADCAST_TERMS", most)
    sizes, original = [], R.unit_weights
    monkeypatch.setattr(R, "unit_weights", lambda f, vocab, *rest: sizes.append(vocab.count()) or original(f, vocab, *rest))
    got = {r["query_id"]: r["doc_id"][:2] for r in R.retrieve_scores(asked, index, 1).collect()}
    assert got == {"q": "03", "r": "05"}
    # lamp, hums, hums w3, w3, w5
    assert sizes == [5 if most else index.vocab.count()] and index.vocab.count() > 5
