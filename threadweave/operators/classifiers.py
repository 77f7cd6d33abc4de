"""Intent classifiers on Spark ML over TF-IDF features."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel,
)
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from threadweave import fixed_values as FV
from threadweave.functions.normalize import has_text, strip
from threadweave.operators.dual_svm import fit_dual
from threadweave.operators.sampling import stratified_split
from threadweave.operators.tfidf import with_grams
from threadweave.operators.weak_training import class_weights
from threadweave.schema import require_columns
from threadweave.session import cut_lineage
from threadweave.sources.tables import deal

VOCABULARY_SIZE = 1 << 24  # a fit whose vocabulary fills this fails; no term is dropped silently
ROWS_A_TASK = 50_000  # of those a fit learns from, each of which is read in every iteration
CUT_SHIFT = 48  # the leading 16 bits of the hash: 65,536 counts on the driver


def load_weak_training(df: DataFrame, labels: Sequence[str] = tuple(FV.TAXONOMY)) -> DataFrame:
    """S6. Rows with text and a label of the taxonomy; an empty result is an error."""
    require_columns(df, ["customer_text", "weak_intent"], "weak training table")
    usable = df.na.drop(subset=["customer_text", "weak_intent"]).filter(F.col("weak_intent").isin(*labels))
    if usable.isEmpty():
        raise ValueError("no usable weak training rows after filtering")
    return usable


def fit_features(df: DataFrame, text: str, analyzer: str = "word", min_df: int = FV.TFIDF_MIN_DF) -> PipelineModel:
    """M1-M3 as Spark ML stages over the term arrays.

    Spark's IDF lacks the added one of the formula wanted here, so the counts are scaled by
    idf + 1 through an element-wise product.
    """
    grams = with_grams(df.select(text), text, analyzer).select("grams")
    counter = CountVectorizer(
        inputCol="grams", outputCol="counts", minDF=float(min_df), vocabSize=VOCABULARY_SIZE
    ).fit(grams)
    if len(counter.vocabulary) >= VOCABULARY_SIZE:
        raise ValueError("the vocabulary is full; raise min_df")
    idf = IDF(inputCol="counts", outputCol="weighted").fit(counter.transform(grams))
    scale = ElementwiseProduct(
        inputCol="counts", outputCol="weighted", scalingVec=Vectors.dense(idf.idf.toArray() + 1.0)
    )
    return PipelineModel([counter, scale, Normalizer(inputCol="weighted", outputCol="features", p=2.0)])


@dataclass
class IntentModel:
    """Features, classifier and label list; labels are in name order."""

    kind: str
    analyzer: str
    labels: list[str]
    features: PipelineModel
    classifier: LogisticRegressionModel | OneVsRestModel
    meta: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, text: str = "customer_text") -> DataFrame:
        """M10. Adds label, confidence and the per-label map; blank texts are left out
        (``blank_messages`` lists them)."""
        usable = df.filter(has_text(text)).withColumn("_text", strip(text))
        vectors = self.features.transform(with_grams(usable, "_text", self.analyzer))
        scored = self.classifier.transform(vectors)
        names = F.array(*[F.lit(n) for n in self.labels])
        if self.kind == "logreg":
            weights: Column = vector_to_array("probability")
            extra = {"probabilities": F.map_from_arrays(names, weights)}
            confidence = "classifier_confidence"
        else:
            decisions = vector_to_array("rawPrediction")
            weights = softmax(decisions)
            extra = {
                "decision_scores": F.map_from_arrays(names, decisions),
                "score_weights": F.map_from_arrays(names, weights),
            }
            confidence = "confidence_like"
        label = F.get(names, F.col("prediction").cast("int"))
        return scored.select(
            *df.columns, label.alias("predicted_intent"), F.array_max(weights).alias(confidence),
            *[c.alias(n) for n, c in extra.items()],
        )

    def save(self, path: str) -> None:
        """S10. Spark ML folders for both parts and one JSON row for the rest."""
        self.features.write().overwrite().save(f"{path}/features")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        row = json.dumps(
            {"kind": self.kind, "analyzer": self.analyzer, "labels": self.labels, "meta": self.meta}
        )
        spark = SparkSession.active()
        spark.createDataFrame([(row,)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IntentModel:
        about = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        reader = LogisticRegressionModel if about["kind"] == "logreg" else OneVsRestModel
        return IntentModel(
            about["kind"], about["analyzer"], about["labels"],
            PipelineModel.load(f"{path}/features"), reader.load(f"{path}/classifier"), about["meta"],
        )


def blank_messages(df: DataFrame, text: str = "customer_text") -> DataFrame:
    """Rows a classifier cannot take."""
    return df.filter(~has_text(text))


def softmax(scores: Column) -> Column:
    """M9. Shifted by the maximum; a ranking aid, not a calibrated probability."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda r: r / total)


def chosen_rows(train: DataFrame, text: str, label: str, most_rows: int) -> DataFrame:
    """Text and label of the first ``most_rows`` rows by hash and text, without ranking all rows in one task.

    Counts by the leading bits of the hash find the bucket of the cut; all rows before it stay, and only the distinct
    rows of that bucket, some 1 in 65,536, are ranked, with the number of their copies.
    """
    place = F.xxhash64(text, label)
    rows = train.select(text, label).withColumns({"_place": place, "_bucket": F.shiftright(place, CUT_SHIFT)})
    before, cut = 0, None
    for cut, n in sorted((r["_bucket"], r["n"]) for r in rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()):
        if before + n >= most_rows:
            break
        before += n
    else:
        return rows.select(text, label)
    distinct = rows.filter(F.col("_bucket") == cut).groupBy("_place", text, label).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_place", text, label).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(most_rows - before) - F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    last = distinct.withColumn("_n", F.least("_n", left).cast("int")).filter("_n > 0")
    copies = last.select(text, label, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy"))
    return rows.filter(F.col("_bucket") < cut).select(text, label).unionByName(copies.drop("_copy"))


def _prepared(
    train: DataFrame, text: str, label: str, analyzer: str, weighting: str, most_rows: int | None = None
) -> tuple[list[str], PipelineModel, DataFrame, int]:
    """Features, label index and class weight of the training rows, kept for the iterations; of all of them unless
    a caller asks for ``most_rows``."""
    train = train.select(text, label) if most_rows is None else chosen_rows(train, text, label, most_rows)
    # Kept as dealt out: files of them would be read back in fewer, larger splits.
    train = deal(cut_lineage(train), ROWS_A_TASK).persist(StorageLevel.MEMORY_AND_DISK)
    weights = cut_lineage(class_weights(train, label, weighting))
    # One row per label.
    labels = sorted(r[label] for r in weights.select(label).collect())
    features = fit_features(train, text, analyzer)
    indexed = train.join(F.broadcast(weights.select(label, "weight")), label)
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    vectors = features.transform(with_grams(indexed, text, analyzer)).select(
        "features", "weight", index.cast("double").alias("label")
    ).persist(StorageLevel.MEMORY_AND_DISK)
    n = vectors.count()
    train.unpersist()
    return labels, features, vectors, n


def fit_logreg(
    train: DataFrame, text: str = "customer_text", label: str = "weak_intent", analyzer: str = "word",
    weighting: str = "balanced", c: float = 1.0, max_iter: int = FV.LOGREG_MAX_ITER, most_rows: int | None = None,
) -> IntentModel:
    """M5/M12-M14. Multinomial logistic regression on all labelled rows, or on ``most_rows`` of them if a caller says so.

    Spark averages the loss over the weights, so a penalty of 1 / (C * n) is the same
    objective as C times the summed loss.
    """
    labels, features, vectors, n = _prepared(train, text, label, analyzer, weighting, most_rows)
    try:
        total = vectors.agg(F.sum("weight")).first()[0]
        model = LogisticRegression(
            family="multinomial", weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0,
            standardization=False, maxIter=max_iter, tol=FV.SOLVER_TOLERANCE,
        ).fit(vectors)
    finally:
        vectors.unpersist()
    return IntentModel("logreg", analyzer, labels, features, model, {"train_size": n, "weighting": weighting})


def fit_svm(
    train: DataFrame, text: str = "customer_text", label: str = "weak_intent", analyzer: str = "word",
    weighting: str = "balanced", c: float = 1.0, max_iter: int = FV.SVM_MAX_ITER, most_rows: int | None = None,
) -> IntentModel:
    """M7. One linear SVM per label against the rest, as models of Spark ML.

    The loss is the plain hinge, where other solvers square it, so margins differ a little and
    rankings rarely. The class weight of a row counts in every label's fit. Coefficients and gradients stay with
    the rows while they are fitted (``fit_dual``); ``LinearSVC`` sends a gradient to the driver in every evaluation.
    """
    labels, features, vectors, n = _prepared(train, text, label, analyzer, weighting, most_rows)
    try:
        weights, starts, figures = fit_dual(vectors, len(features.stages[0].vocabulary), len(labels), c, max_iter)
    finally:
        vectors.unpersist()
    models = [_svc_model(w, start) for w, start in zip(weights, starts)]
    model = OneVsRest(classifier=LinearSVC(maxIter=max_iter, standardization=False), weightCol="weight")._copyValues(OneVsRestModel(models))
    model.setRawPredictionCol("rawPrediction")
    return IntentModel("svm", analyzer, labels, features, model, {"train_size": n, "weighting": weighting, **figures})


def _svc_model(weights: np.ndarray, start: float) -> LinearSVCModel:
    """A model with given coefficients, which Spark has no call for."""
    name = "org.apache.spark.ml.classification.LinearSVCModel"
    return LinearSVCModel(JavaWrapper._new_java_obj(name, f"LinearSVC_{uuid.uuid4().hex[:12]}", Vectors.dense(weights), float(start)))


def split_rows(rows: DataFrame, key: str, fraction: float = FV.VALIDATION_FRACTION, seed: int = FV.SEED) -> DataFrame:
    return stratified_split(rows, "weak_intent", key, fraction, seed)


def pseudo_labels(
    model, unlabelled: DataFrame, text: str = "customer_text",
    threshold: float = FV.PSEUDO_LABEL_CONFIDENCE,
) -> DataFrame:
    """M15. Confident predictions on rows without a label, of any model with ``predict``."""
    scored = model.predict(unlabelled.drop("weak_intent"), text)
    kept = [c for c in unlabelled.columns if c != "weak_intent"]
    return scored.filter(F.col("classifier_confidence") >= threshold).select(
        *kept, F.col("predicted_intent").alias("weak_intent")
    )


def self_train(
    labelled: DataFrame, unlabelled: DataFrame, text: str = "customer_text",
    threshold: float = FV.PSEUDO_LABEL_CONFIDENCE, fit: Callable | None = None, **fit_options,
) -> tuple[IntentModel, DataFrame]:
    """M15. Fit, add confident predictions, fit again; by logistic regression unless another ``fit`` is given."""
    fit = fit or fit_logreg
    first = fit(labelled, text, **fit_options)
    added = cut_lineage(pseudo_labels(first, unlabelled, text, threshold))  # not scored again by what reads them
    keep = [c for c in labelled.columns if c in added.columns]
    return fit(labelled.select(*keep).unionByName(added.select(*keep)), text, **fit_options), added
