"""From documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.llm.given import KEEP_FROM, quality_model, tokenizer_path
from threadweave.llm.packing import pack_posts
from threadweave.llm.quality_neighbours import score_post_neighbours
from threadweave.llm.quality_rules import score_post_quality
from threadweave.llm.simhash import near_duplicate_posts
from threadweave.session import cut_lineage, import_on_workers

NEAR_BITS = 3  # of 64, as is usual for SimHash


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Whole rows are judged, so ids may be null or repeat, repeated rows stay or go together and columns of any
    name come through unchanged. Null or empty texts have no words and go. No documents give none.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score_post_quality(rows, id_column="row").filter("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled documents vote for quality.

    The labelled examples come from the documents table as given: most bad ones are gone from ``docs``.
    A null or empty text has no neighbours and scores the labelled mean. Ids are not looked at; repeated rows stay
    or go together and columns of any name come through unchanged. No documents give none.
    """
    model = quality_model(import_on_workers(spark), sf_dir)
    score = _free(docs, "score")
    scored = score_post_neighbours(docs, model, score_column=score)
    return scored.filter(F.col(score) >= KEEP_FROM).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, a null id being largest.

    Near means SimHash fingerprints (64 bits, majority of the hashes of three-word shingles) that differ in at most
    ``NEAR_BITS`` bits, and whatever such links connect. Documents without words are alike; rows of one id and text are
    one. Columns of any name come through unchanged.
    """
    import_on_workers(spark)
    row = _free(docs, "row")
    name = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    groups = near_duplicate_posts(docs.select(name.alias("tweet_id"), "text"), NEAR_BITS)
    kept = groups.filter(F.col("tweet_id") == F.col("component_id")).select(F.col("tweet_id").alias(row)).distinct()
    staying = docs.withColumn(row, name).join(kept, row, "left_semi")
    return staying.dropDuplicates([row]).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 2048 tokens.

    A null or empty text is a piece of its closing token; null ids and repeated rows are packed like any other. Further
    columns are not read. No documents give no pieces.
    """
    import_on_workers(spark)
    return pack_posts(docs, tokenizer_path(), id_column="doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Accuracies by expectation-maximisation, votes in a latent space and token ids are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut_lineage(docs)
    return docs
