import math

import pytest
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.operators import classifiers as C
from threadweave.operators import metrics as M
from threadweave.operators.retrieval import build_index
from threadweave.operators.tfidf import with_grams
from threadweave.operators.weak_training import class_weights
from threadweave.plans import runs
from threadweave.streaming.incremental import first_posts, label_stream, stream_posts

TEMPLATES = [  # one per label, in the order of the labels
    "battery performance got poor", "slow charging by any plug", "the upgrade keeps failing at verifying update", "boot loop every morning",
    "hotspot issue on the train", "two-factor sends me nothing", "app store spinning for hours", "podcasts freezing midway",
    "billing error on my card", "family sharing shows nobody", "out of storage once more", "where do i turn off the sounds", "thx",
]


def labelled(spark, copies=8):
    rows = [(f"{i}-{j}", f"{t} number{j % 3}", FV.TAXONOMY[i]) for i, t in enumerate(TEMPLATES) for j in range(copies)]
    return spark.createDataFrame(rows, "customer_tweet_id string, customer_text string, weak_intent string")


def vectors(spark, true, pred):
    return spark.createDataFrame(list(zip(true, pred)), "t string, p string")


def test_metrics(spark):
    perfect = M.overall_metrics(vectors(spark, "abc", "abc"), "t", "p").first()
    assert (perfect["accuracy"], perfect["macro_f1"], perfect["n_examples"]) == (1.0, 1.0, 3)
    wrong = M.overall_metrics(vectors(spark, "ab", "ba"), "t", "p").first()
    assert (wrong["accuracy"], wrong["macro_f1"]) == (0.0, 0.0)
    mixed = vectors(spark, "aabb", "aaba")
    rows = {r["label"]: r for r in M.per_label_metrics(mixed, "t", "p", ["b", "a"]).collect()}
    assert rows["a"]["precision"] == pytest.approx(2 / 3) and rows["a"]["recall"] == 1.0 and rows["b"]["support"] == 2
    assert rows["b"]["ord"] == 1
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in M.confusion_matrix(mixed, "t", "p").collect()}
    assert cells == {("a", "a"): 2, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 1}
    report = {r["label"]: r["f1"] for r in M.classification_report(mixed, "t", "p", []).collect()}
    assert report["macro avg"] == pytest.approx((0.8 + 2 / 3) / 2) and report["accuracy"] == 0.75
    margin = M.accuracy_margin(vectors(spark, "a" * 200, "a" * 128 + "b" * 72), "t", "p").first()
    assert round(margin["margin"], 4) == round(1.96 * math.sqrt(0.64 * 0.36 / 200), 4)
    assert M.overall_metrics(mixed.filter("false"), "t", "p").first()["accuracy"] == 0.0


@pytest.fixture(scope="module")
def logreg(spark):
    return C.fit_logreg(labelled(spark))


def test_logreg(spark, logreg, tmp_path):
    got = logreg.predict(labelled(spark).union(spark.createDataFrame([("b", " ", "x")], labelled(spark).schema)))
    rows = got.collect()
    assert len(rows) == 104 and C.blank_messages(spark.createDataFrame([(" ",)], "customer_text string")).count() == 1
    assert all(r["predicted_intent"] == r["weak_intent"] for r in rows)
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 and set(r["probabilities"]) == set(FV.TAXONOMY) for r in rows)
    assert all(r["classifier_confidence"] == max(r["probabilities"].values()) for r in rows)
    logreg.save(str(tmp_path / "m"))
    again = C.IntentModel.load(spark, str(tmp_path / "m")).predict(labelled(spark)).collect()
    assert {r["customer_tweet_id"]: r["classifier_confidence"] for r in again} == {r["customer_tweet_id"]: r["classifier_confidence"] for r in rows}


def test_svm_is_a_model_per_label(spark, tmp_path):
    rows = labelled(spark, 4).filter(F.col("weak_intent").isin(*FV.TAXONOMY[:4]))
    model = C.fit_svm(rows, max_iter=30)
    out = model.predict(rows).collect()
    assert all(r["predicted_intent"] == r["weak_intent"] for r in out)
    assert all(abs(sum(r["score_weights"].values()) - 1) < 1e-9 for r in out)
    assert all(r["predicted_intent"] == max(r["decision_scores"], key=r["decision_scores"].get) for r in out)
    assert all("probabilities" not in r.asDict() for r in out) and len(model.classifier.models) == 4
    model.save(str(tmp_path / "svm"))
    assert C.IntentModel.load(spark, str(tmp_path / "svm")).predict(rows).first()["predicted_intent"] in FV.TAXONOMY


def test_training_run_char_features_and_self_training(spark, tmp_path):
    model, figures = runs.train_and_validate(labelled(spark), analyzer="char", weighting="sqrt", path=str(tmp_path / "m"))
    row = figures.first()
    assert row["n_examples"] == 26 and row["accuracy"] >= 0.9
    assert C.IntentModel.load(spark, str(tmp_path / "m")).meta["validation_size"] == 26
    unlabelled = spark.createDataFrame([("u", "battery performance got poor number1", None)], labelled(spark).schema)
    assert [r["weak_intent"] for r in C.pseudo_labels(model, unlabelled, threshold=0.2).collect()] == ["battery_drain"]
    with pytest.raises(ValueError):
        C.load_weak_training(labelled(spark).filter("false"))


def test_two_models_and_end_to_end(spark, logreg):
    golden = labelled(spark, 1).select(
        F.col("customer_tweet_id").alias("example_id"), "customer_tweet_id", "customer_text", F.col("weak_intent").alias("annotator_label")
    )
    flags = runs.evaluate_models(logreg, logreg, golden)
    assert flags.filter("both_correct").count() == 13 and M.agreement(flags).count() == 4
    assert runs.evaluate_model(logreg, golden)["metrics"].first()["accuracy"] == 1.0
    pairs = spark.createDataFrame(
        [(str(i), f"a{i}", f"{t} number1", "Go to Settings and restart the phone. DM us.") for i, t in enumerate(TEMPLATES)],
        "customer_tweet_id string, agent_tweet_id string, customer_text string, agent_text string",
    )
    scored = runs.score_messages(golden, logreg, build_index(pairs, min_df=1), k=2)
    rows = scored.collect()
    assert len(rows) == 13 and all(len(r["evidence"]) == 2 for r in rows)
    assert {r["decision"] for r in rows} <= {"auto_handle", "escalate"}
    odd = golden.limit(1).unionByName(golden.limit(1).withColumn("example_id", F.lit("blank")).withColumn("customer_text", F.lit(" ")))
    told = {r["example_id"]: (r["error"], r["decision"] is None) for r in runs.score_messages(odd, logreg, build_index(pairs, min_df=1)).collect()}
    assert len(told) == 2 and told.pop("blank") == ("blank_message", True) and {*told.values()} == {(None, False)}
    few = C.fit_logreg(labelled(spark), most_rows=40)
    assert few.meta["train_size"] == 40
    loose = runs.score_messages(golden, logreg, build_index(pairs, min_df=1), confidence_threshold=0.0)
    report = runs.decision_report(loose)
    assert report["metrics"].first()["n_examples"] == 13
    assert {r["decision"]: r["n"] for r in report["decisions"].collect()} == {"auto_handle": 12, "escalate": 1}


def test_labels_on_a_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        ",".join(FV.POST_COLUMNS) + "\n1.0,u,True,,battery performance got poor,,\n2,d,False,,ok,,1\n3,u,True,,nothing here,,\n"
    )
    query = label_stream(stream_posts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r["tweet_id"]: r["weak_intent"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": "battery_drain", "3": None}


def test_first_row_of_an_id_on_a_file_stream(spark, tmp_path):
    """An id repeated in one file, in a later micro-batch and after a restart gives one row; undated posts count too."""
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(name, *rows):
        (folder / name).write_text(",".join(FV.POST_COLUMNS) + "\n" + "".join(f"{r}\n" for r in rows))

    def run():
        query = label_stream(
            first_posts(stream_posts(spark, str(folder), files_per_batch=1)), str(tmp_path / "out"), str(tmp_path / "state")
        )
        query.awaitTermination(180)
        return sorted((r["tweet_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive("a.csv", "1.0,u,True,,first,,", "1,u,True,,again,,", "2,u,True,Tue Oct 31 22:10:47 +0000 2017,dated,,")
    assert run() == [("1", "first"), ("2", "dated")]
    arrive("b.csv", "1,u,True,,later,,", "2,u,True,,later,,", "3,u,True,Tue Oct 31 22:10:47 +0000 2006,old,,")
    assert run() == [("1", "first"), ("2", "dated"), ("3", "old")]


def test_rows_a_fit_learns_from_are_chosen_and_kept_over_all_cores(spark):
    rows = labelled(spark).select("customer_text", "weak_intent")
    rows = rows.unionByName(rows.limit(30)).unionByName(spark.createDataFrame([("same text", "battery_drain")] * 50, rows.schema))
    for most in (1, 7, 40, 100, rows.count(), rows.count() + 5):
        first = rows.orderBy(F.xxhash64("customer_text", "weak_intent"), "customer_text").limit(most)
        assert sorted(C.chosen_rows(rows, "customer_text", "weak_intent", most).collect()) == sorted(first.collect()), most
    vectors = C._prepared(rows, "customer_text", "weak_intent", "char", "sqrt", 60)[2]
    held = vectors.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    vectors.unpersist()
    assert sum(held) == 60 and max(held) <= 30 and sum(n > 0 for n in held) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kind", ["logreg", "logreg_chars", "svm"])
def test_a_fit_learns_from_all_rows(spark, monkeypatch, kind):
    """More rows than a fit once took; what goes into the iterations is counted, and the solver left out."""
    n = 1_000_050
    rows = spark.range(n, numPartitions=4).select(
        F.concat(F.lit("tea w"), (F.col("id") % 40).cast("string")).alias("customer_text"), F.when(F.col("id") % 3 == 0, "other").otherwise("battery_drain").alias("weak_intent")
    )
    taken = []

    def counted(df):
        taken.append(df.count())
        raise InterruptedError

    monkeypatch.setattr(C, "cut_lineage", counted)
    with pytest.raises(InterruptedError):
        C.fit_svm(rows) if kind == "svm" else C.fit_logreg(rows, analyzer="char" if kind == "logreg_chars" else "word")
    assert taken == [n]
