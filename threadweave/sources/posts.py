"""Post scans: CSV, normalisation, first-per-id, brand-linked reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions import normalize as N
from threadweave.operators.common import top_per_key
from threadweave.schema import require_columns
from threadweave.session import cut_lineage


def null_words(df: DataFrame) -> DataFrame:
    """CSV only: words that stand for a missing value become null in every text column."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin(FV.CSV_NULL_WORDS), F.col(f.name)).alias(f.name)
            if f.dataType.typeName() == "string"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def line_options(multiline: bool) -> dict[str, str]:
    """Reader options for quoted texts.

    With ``multiline`` quoted texts may hold line breaks, and a file is read by one task; a table of many
    files is spread by file. Without it files are split, and a record torn by a line break fails
    the read instead of being lost.
    """
    return {"header": "true", "escape": '"', "multiLine": str(multiline).lower(), "mode": "PERMISSIVE" if multiline else "FAILFAST"}


def read_csv(spark: SparkSession, path: str, multiline: bool = True, **options: str) -> DataFrame:
    """A headed CSV with every column as text (``line_options``). A missing path raises at once."""
    reader = spark.read.options(**line_options(multiline))
    for key, value in options.items():
        reader = reader.option(key, value)
    return null_words(reader.csv(path))


def read_posts_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """S1/S2. Raw posts, ids as text, with ``ingest_seq`` in file order.

    The header is checked against the required columns before any row is read.
    """
    header = spark.read.options(**line_options(True)).csv(path)
    require_columns(header, FV.POST_COLUMNS, "post CSV")
    raw = spark.read.schema(_file_order_schema(header)).options(**line_options(multiline)).csv(path)
    return null_words(raw.select(*FV.POST_COLUMNS, scan_order().alias("ingest_seq")))


def _file_order_schema(header: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(c, T.StringType()) for c in header.columns])


def scan_order() -> Column:
    """Position of a row in its input: file, split offset, row within the scan task.

    Taken at the scan, before any shuffle, and ordered as a whole.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )


def normalize_posts(raw: DataFrame) -> DataFrame:
    """P3. One projection and one filter; rows without id or author are dropped."""
    require_columns(raw, FV.POST_COLUMNS, "posts")
    kept = [c for c in raw.columns if c not in FV.POST_COLUMNS]
    created = (
        F.col("created_at")
        if raw.schema["created_at"].dataType.typeName() == "timestamp"
        else N.parse_created_at("created_at")
    )
    return raw.select(
        N.normalize_id("tweet_id").alias("tweet_id"),
        N.normalize_id("author_id").alias("author_id"),
        N.parse_inbound("inbound").alias("inbound"),
        created.alias("created_at"),
        F.coalesce("text", F.lit("")).alias("text"),
        N.normalize_id("response_tweet_id").alias("response_tweet_id"),
        N.normalize_id("in_response_to_tweet_id").alias("in_response_to_tweet_id"),
        *kept,
    ).filter(F.col("tweet_id").isNotNull() & F.col("author_id").isNotNull())


def first_per_id(posts: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """S3. First occurrence of every id."""
    return top_per_key(posts, ["tweet_id"], [F.col(order)]).drop("_rank")


def load_posts(spark: SparkSession, path: str, brand: str | None = None, multiline: bool = True) -> DataFrame:
    """S3/S4. All posts of a CSV, or only those linked to a brand.

    The brand's reduction looks at the posts four times and joins on their row numbers, so the CSV is parsed once into
    a table that holds the numbers as the scan gave them.
    """
    posts = normalize_posts(read_posts_csv(spark, path, multiline))
    return first_per_id(posts) if brand is None else brand_linked(cut_lineage(posts), brand)


def brand_seed_ids(posts: DataFrame, brand: str) -> DataFrame:
    """J1. Ids of the brand's posts, of what they answer, and of what answers them."""
    own = posts.filter(F.col("author_id") == brand)
    seeds = F.concat(
        F.array("tweet_id", "in_response_to_tweet_id"), N.parse_response_ids("response_tweet_id")
    )
    return (
        own.select(F.explode(seeds).alias("seed_id")).filter(F.col("seed_id").isNotNull()).distinct()
    )


def brand_linked(posts: DataFrame, brand: str) -> DataFrame:
    """J1/S4. Posts by the brand, in the seed set, or answering a seed.

    The ids of linked posts come first, from narrow rows: two semi-joins on (id, author, parent), which
    drop posts without a parent early and can carry runtime filters. Texts are attached by one more
    semi-join to the posts that stay. A linked post is one whose own row is linked, so the choice
    carries the row's sequence number, which only the first row of an id survives.
    """
    seeds = brand_seed_ids(posts, brand)
    narrow = posts.select("tweet_id", "author_id", "in_response_to_tweet_id", "ingest_seq")
    own = narrow.filter(F.col("author_id") == brand)
    named = narrow.join(seeds.withColumnRenamed("seed_id", "tweet_id"), "tweet_id", "left_semi")
    answering = narrow.filter(F.col("in_response_to_tweet_id").isNotNull()).join(
        seeds.withColumnRenamed("seed_id", "in_response_to_tweet_id"), "in_response_to_tweet_id", "left_semi"
    )
    row = ["tweet_id", "ingest_seq"]
    chosen = own.select(*row).unionByName(named.select(*row)).unionByName(answering.select(*row))
    first = chosen.groupBy("tweet_id").agg(F.min("ingest_seq").alias("ingest_seq"))
    return posts.join(first, row, "left_semi").transform(first_per_id)
