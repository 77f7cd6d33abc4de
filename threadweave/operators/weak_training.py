"""Weak training rows and their counts (W7, J3, M11, M14, M16, E7-style summaries)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions.patterns import SCREEN, PatternSet, found, with_screen
from threadweave.functions.weak_intent import with_weak_intent
from threadweave.operators.common import taxonomy_frame
from threadweave.schema import require_columns


def exclude_ids(df: DataFrame, ids: DataFrame, key: str = "customer_tweet_id") -> DataFrame:
    """J3. Rows whose id is not reserved. The size of the id list decides the join."""
    reserved = ids.select(F.col(ids.columns[0]).cast("string").alias(key)).filter(F.col(key).isNotNull())
    return df.join(reserved, key, "left_anti")


def weak_labels(pairs: DataFrame, reserved: DataFrame | None = None, key: str = "customer_tweet_id",
                text: str = "customer_text") -> DataFrame:
    """W1 over the rows left after exclusion; ambiguous rows keep a null label."""
    require_columns(pairs, [key, text], "pairs")
    open_rows = exclude_ids(pairs, reserved, key) if reserved is not None else pairs
    return with_weak_intent(open_rows, text)


def weak_training_rows(labelled: DataFrame) -> DataFrame:
    """W7. Labelled rows only."""
    keep = [c for c in FV.WEAK_COLUMNS if c in labelled.columns]
    return labelled.filter(F.col("weak_intent").isNotNull()).select(*keep)


def weak_intent_counts(labelled: DataFrame, labels: Sequence[str] = tuple(FV.TAXONOMY)) -> DataFrame:
    """W7. Rows per label in taxonomy order, zeros included."""
    counts = labelled.filter(F.col("weak_intent").isNotNull()).groupBy("weak_intent").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        taxonomy_frame(labelled, labels, "weak_intent")
        .join(counts, "weak_intent", "left")
        .select("ord", "weak_intent", F.coalesce("n", F.lit(0)).alias("n"))
    )


def weak_training_summary(pairs: DataFrame, reserved: DataFrame, labelled: DataFrame) -> DataFrame:
    """W7. Row counts before and after exclusion, labelled and unlabelled, as one row."""
    before = pairs.select(F.lit("total").alias("what"), F.lit(None).cast("string").alias("label"))
    ids = reserved.select(F.col(reserved.columns[0]).alias("id")).filter("id IS NOT NULL").distinct()
    excluded = ids.select(F.lit("excluded").alias("what"), F.lit(None).cast("string").alias("label"))
    after = labelled.select(F.lit("after").alias("what"), F.col("weak_intent").alias("label"))
    rows = before.unionByName(excluded).unionByName(after)
    is_after = F.col("what") == "after"
    return rows.agg(
        F.count_if(F.col("what") == "total").alias("total_historical_pairs"),
        F.count_if(F.col("what") == "excluded").alias("excluded_golden_customer_tweets"),
        F.count_if(is_after).alias("pairs_after_golden_exclusion"),
        F.count_if(is_after & F.col("label").isNotNull()).alias("labelled_examples"),
        F.count_if(is_after & F.col("label").isNull()).alias("unlabelled_examples"),
    )


def class_weights(df: DataFrame, label: str, scheme: str = "balanced") -> DataFrame:
    """M11/M14. One weight per class: ``balanced`` n/(k*n_class), ``sqrt`` of it, or ``none``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per label from here on, so a window over all of them is a handful of rows.
    whole = Window.partitionBy(F.lit(0))
    balanced = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    weight: Column = {"balanced": balanced, "sqrt": F.sqrt(balanced), "none": F.lit(1.0)}[scheme]
    return counts.select(label, "n", weight.alias("weight"))


def expand_labels(labelled: DataFrame, loose: PatternSet, text: str = "customer_text") -> DataFrame:
    """M16. Rows the strict rules left open take the first looser pattern that matches."""
    second = F.lit(None).cast("string")
    screened = [pattern for _, pattern in loose]
    for name, pattern in reversed(list(loose)):
        second = F.when(found(text, pattern, screened=screened), F.lit(name)).otherwise(second)
    return with_screen(labelled, text, screened).withColumn("weak_intent", F.coalesce("weak_intent", second)).drop(SCREEN)
