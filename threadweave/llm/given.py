"""The given tables as this package's records, shared by the queries and the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.llm.quality_neighbours import NeighbourModel, fit_post_quality

KEEP_FROM = 0.3  # the quality score from which on a document counts as good


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as posts: the id and the whole text."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("tweet_id"), "text")


def tokenizer_path() -> str:
    """Where the vocabulary file lies; it is installed on the driver and every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(id_column: str) -> Column:
    """Whether a row is kept back from learning: one in five, by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def quality_model(spark: SparkSession, folder: str) -> NeighbourModel:
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("tweet_id"), "quality")
    return fit_post_quality(document_posts(spark, folder), labels.filter(~held_out("tweet_id")))
