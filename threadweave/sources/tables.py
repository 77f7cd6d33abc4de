"""Typed loaders for the tables between stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions.normalize import has_text, strip
from threadweave.schema import require_columns
from threadweave.sources.posts import read_csv


SHOWN_VIOLATIONS = 20  # in an error text; golden_violations has them all


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage table: parquet unless the path ends in ``.csv``."""
    return read_csv(spark, path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Enough tasks for row work that costs far more than reading the row.

    A table of many files already has more splits than the cluster has cores and is left
    alone; one of few splits (a single parquet row group is a single task) is dealt out
    over the cores before patterns or tokenisers run on it. Column pruning and pushed
    filters pass through.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def deal(df: DataFrame, rows_a_task: int) -> DataFrame:
    """Rows dealt out evenly, at most so many to a task, over all cores at least.

    For work whose time is in the rows: splits of a file follow its bytes and row groups, so small rows make tasks
    that grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows_a_task)))


def reserved_ids(spark: SparkSession, path: str | None) -> DataFrame:
    """S8. Ids set aside for evaluation; a missing path gives no ids."""
    try:
        if path is not None:
            ids = read_table(spark, path).select(F.col("customer_tweet_id").cast("string"))
            return ids.na.drop().distinct()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
    return spark.createDataFrame([], "customer_tweet_id string")


def golden_violations(
    df: DataFrame, labels: Sequence[str] = tuple(FV.TAXONOMY), label: str = "annotator_label",
    text: str = "customer_text",
) -> DataFrame:
    """S7 as a report: ``(rule, detail, n)``, one row per broken rule and unknown label."""
    name = strip(F.coalesce(F.col(label), F.lit("")))
    rules = F.array_compact(
        F.array(
            F.when(name == "", F.struct(F.lit("empty_label").alias("rule"), F.lit("").alias("detail"))),
            F.when(~has_text(text), F.struct(F.lit("empty_text").alias("rule"), F.lit("").alias("detail"))),
            F.when(
                (name != "") & ~name.isin(*labels),
                F.struct(F.lit("unknown_label").alias("rule"), name.alias("detail")),
            ),
        )
    )
    return df.select(F.explode(rules).alias("r")).groupBy("r.rule", "r.detail").agg(
        F.count(F.lit(1)).alias("n")
    )


def check_golden_set(df: DataFrame, labels: Sequence[str] = tuple(FV.TAXONOMY)) -> DataFrame:
    """S7. The labelled set with trimmed text and label, or an error that names the problem."""
    require_columns(df, FV.GOLDEN_COLUMNS, "golden set")
    violations = golden_violations(df, labels)
    worst = violations.orderBy("rule", "detail").take(SHOWN_VIOLATIONS)
    if worst:
        told = "; ".join(f"{r['rule']} {r['detail']} ({r['n']} rows)".replace("  ", " ") for r in worst)
        more = violations.count() - len(worst)
        raise ValueError(f"golden set is not usable: {told}" + f"; {more} more kinds (golden_violations)" * bool(more))
    return df.withColumns(
        {"annotator_label": strip("annotator_label"), "customer_text": strip("customer_text")}
    )
