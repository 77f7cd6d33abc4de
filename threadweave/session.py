"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# What the operators count on. All of it is Spark's own machinery: AQE splits hot join
# keys and re-picks join strategies from real sizes, so no operator broadcasts by hand
# anything that grows with the data.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "threadweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine settings; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names.

    Only a local session without one gets a folder of its own; on a cluster a missing
    ``spark.checkpoint.dir`` is an error, since an executor-local folder would not survive
    the loss of that executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="threadweave-checkpoints-")
    context.setCheckpointDir(named)
    return named


_WRITTEN: list[str] = []


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and go on from there.

    Parquet rather than checkpointed rows: later reads take only the columns they need, have
    sizes to plan with, and survive the loss of any executor. ``drop_written`` removes the
    tables; a driver that ends normally does so by itself.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder, compression=compression)
    note_written(folder)
    return spark.read.schema(df.schema).parquet(folder)


def note_written(folder: str) -> str:
    """Have ``drop_written`` remove this folder too."""
    if not _WRITTEN:
        atexit.register(drop_written)
    _WRITTEN.append(folder)
    return folder


def drop_written(spark: SparkSession | None = None) -> int:
    """Delete the tables ``cut_lineage`` has written so far and return their number."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return 0
    dropped = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        dropped += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


def import_on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Executors without that path get the package in Spark's own way (``--py-files``).
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
