"""Classification and routing metrics.

Everything but the first count works on the (true, predicted) table, which has at most
labels x labels rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave import fixed_values as FV


def _ratio(a: Column, b: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _label_order(label: Column, labels: Sequence[str]) -> Column:
    """Position in the given order; labels that are not listed follow by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), label)
    return F.when(place > 0, place).otherwise(len(labels) + 1)


def per_label_metrics(
    df: DataFrame, true: str, pred: str, labels: Sequence[str] = tuple(FV.TAXONOMY)
) -> DataFrame:
    """E1. Precision, recall, F1 and support of every label that occurs on either side."""
    counts = confusion_counts(df, true, pred)
    sides = counts.select(
        F.explode(F.array(
            F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                     F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("bigint").alias("hit")),
        )).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    precision = _ratio(F.col("hit"), F.col("predicted"))
    recall = _ratio(F.col("hit"), F.col("support"))
    return sums.select(
        "label", _label_order(F.col("label"), labels).alias("ord"),
        precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
        "support", "predicted", "hit",
    )


def overall_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """E1/E8. Accuracy, macro averages over the labels that occur, total support."""
    return per_label_metrics(df, true, pred).agg(
        _ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("n_examples"),
    )


def confusion_matrix(df: DataFrame, true: str, pred: str) -> DataFrame:
    """E2. Long form with zeros, over all labels that occur on either side.

    The label list of a task is short; it rides along as one array instead of a join of
    the label table with itself.
    """
    counts = confusion_counts(df, true, pred)
    occurring = F.array_sort(F.array_union(F.collect_set("true_label"), F.collect_set("pred_label")))
    cells = F.map_from_entries(F.collect_list(
        F.struct(F.struct(F.col("true_label").alias("t"), F.col("pred_label").alias("p")), F.col("n"))
    ))
    table = counts.agg(occurring.alias("labels"), cells.alias("cells"))
    return (
        table.select(F.explode("labels").alias("true_label"), "labels", "cells")
        .select("true_label", F.explode("labels").alias("pred_label"), "cells")
        .select(
            "true_label", "pred_label",
            F.coalesce(
                F.element_at("cells", F.struct(F.col("true_label").alias("t"), F.col("pred_label").alias("p"))),
                F.lit(0),
            ).alias("n"),
        )
    )


def confusion_wide(df: DataFrame, true: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """E2. One column per predicted label."""
    return df.groupBy(F.col(true).alias("true_label")).pivot(pred, list(labels)).count().na.fill(0)


def classification_report(
    df: DataFrame, true: str, pred: str, labels: Sequence[str] = tuple(FV.TAXONOMY)
) -> DataFrame:
    """E3. Per-label rows, then accuracy, macro average and weighted average."""
    per_label = per_label_metrics(df, true, pred, labels)
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    accuracy = _ratio(F.sum("hit"), total)
    summary = per_label.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"),
                     accuracy.alias("recall"), accuracy.alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
            F.struct(F.lit("weighted avg").alias("label"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("support")),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    columns = ["label", "precision", "recall", "f1", "support"]
    return per_label.select(*columns).unionByName(summary)


def prediction_table(
    golden: DataFrame, first: DataFrame, second: DataFrame, key: str = "example_id",
    truth: str = "annotator_label", prediction: str = "prediction_label",
) -> DataFrame:
    """E5/J6. Both models' predictions beside the truth, joined by example id."""
    joined = golden.join(
        first.select(key, F.col(prediction).alias("baseline1_prediction")), key
    ).join(second.select(key, F.col(prediction).alias("baseline2_prediction")), key)
    right1 = F.col("baseline1_prediction") == F.col(truth)
    right2 = F.col("baseline2_prediction") == F.col(truth)
    return joined.withColumns(
        {
            "baseline1_correct": right1, "baseline2_correct": right2,
            "both_correct": right1 & right2, "neither_correct": ~right1 & ~right2,
        }
    )


def agreement(predictions: DataFrame) -> DataFrame:
    """E6. How often both, neither or only one of two models is right."""
    one, two = F.col("baseline1_correct"), F.col("baseline2_correct")
    cases = [("both_correct", one & two), ("neither_correct", ~one & ~two),
             ("baseline1_only", one & ~two), ("baseline2_only", two & ~one)]
    return predictions.agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.struct(F.lit(name).alias("outcome"), F.count_if(test).alias("n")) for name, test in cases]).alias("o"),
    ).select("total", F.explode("o").alias("o")).select(
        "o.outcome", "o.n", _ratio(F.col("o.n"), F.col("total")).alias("share")
    )


def better_model(first: DataFrame, second: DataFrame) -> DataFrame:
    """E7. Which of two overall-metric rows is better on accuracy and on macro-F1; ties go to
    the second, as a model must be strictly better to win."""
    a = first.select(F.col("accuracy").alias("a1"), F.col("macro_f1").alias("f1"), F.lit(1).alias("_one"))
    b = second.select(F.col("accuracy").alias("a2"), F.col("macro_f1").alias("f2"), F.lit(1).alias("_one"))
    acc, f1 = F.col("a1") > F.col("a2"), F.col("f1") > F.col("f2")
    return a.join(b, "_one").select(
        F.when(acc, "baseline1").otherwise("baseline2").alias("better_accuracy"),
        F.when(f1, "baseline1").otherwise("baseline2").alias("better_macro_f1"),
        F.when(acc & f1, "baseline1").when(~acc & ~f1, "baseline2").otherwise("split").alias("winner"),
    )


def accuracy_margin(df: DataFrame, true: str, pred: str) -> DataFrame:
    """E18. Accuracy with its 95 % margin of error."""
    right = F.avg(F.when(F.col(true) == F.col(pred), 1.0).otherwise(0.0))
    return df.agg(F.count(F.lit(1)).alias("n_examples"), right.alias("accuracy")).select(
        "n_examples", "accuracy",
        (F.lit(FV.Z_95) * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n_examples"))).alias("margin"),
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """E9. Count and share of every value, such as decisions or reason codes."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # Counting rows needs none of their columns.
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("_total", total).select(
        column, "n", _ratio(100 * F.col("n"), F.col("_total")).alias("pct")
    )


def escalation_rates(df: DataFrame, intent: str = "predicted_intent", decision: str = "decision") -> DataFrame:
    """E10."""
    escalated = F.count_if(F.col(decision) == "escalate")
    return df.groupBy(intent).agg(
        F.count(F.lit(1)).alias("total"), escalated.alias("escalate_count"),
        (100.0 * escalated / F.count(F.lit(1))).alias("escalation_rate_pct"),
    )


def lowest_rows(df: DataFrame, column: str, key: str = "example_id", n: int = 10) -> DataFrame:
    """L8. The n rows with the smallest value; equal values in key order."""
    return df.orderBy(F.asc_nulls_last(column), key).limit(n)
