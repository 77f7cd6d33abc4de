"""Posts arriving as files: the stateless steps on a stream.

Where a single machine would read a post file in chunks to bound its memory, a chunk is a
micro-batch here: new files are read, normalised and labelled once. Those steps look at one row at a time;
only ``first_posts`` keeps state, the ids met so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadweave.functions.weak_intent import with_weak_intent
from threadweave.schema import RAW_POST_SCHEMA
from threadweave.sources.posts import line_options, normalize_posts, null_words


def stream_posts(spark: SparkSession, folder: str, files_per_batch: int = 16, multiline: bool = True) -> DataFrame:
    """S1/P3 over the CSV files that appear in a folder."""
    raw = (
        spark.readStream.schema(RAW_POST_SCHEMA).options(**line_options(multiline))
        .option("maxFilesPerTrigger", files_per_batch).csv(folder)
    )
    return normalize_posts(null_words(raw))


def first_posts(posts: DataFrame, remember: str = "30 days") -> DataFrame:
    """S3 on a stream: the first row of every id, whichever micro-batch brings the others.

    Ids are kept in the query's state store for ``remember`` after their arrival, so state is bounded by
    the posts of that time; an id that comes again later counts as new. Arrival is the time of the micro-batch
    (fixed in the query's log, so a repeated batch decides alike): no post is ever late, and undated posts are
    treated like others. Between files of one micro-batch the first is not defined; with one file per batch it is the
    earlier file.
    """
    arrival = "_arrived_at"
    arrived = posts.withColumn(arrival, F.current_timestamp()).withWatermark(arrival, remember)
    return arrived.dropDuplicatesWithinWatermark(["tweet_id"]).drop(arrival)


def label_stream(posts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """W1 on arriving customer posts; stops when every file at hand has been read."""
    labelled = with_weak_intent(posts.filter("inbound"), "text")
    return (
        labelled.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
