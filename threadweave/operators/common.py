"""Small building blocks several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "_rank"
) -> DataFrame:
    """The first k rows of every key.

    The rank filter lets Spark cut every map task's share of a key to k rows before the
    shuffle (WindowGroupLimit), so one key holding a third of all rows stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection may be copied into every expression and pushed filter that uses it,
    which would run a set of regular expressions over a text several times. A one-row
    generator is a step the optimiser keeps as it is.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def taxonomy_frame(df: DataFrame, labels: Sequence[str], column: str) -> DataFrame:
    """The ordered label list as rows ``(ord, label)``: as many rows as there are labels."""
    spark = df.sparkSession
    exploded = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(name) for name in labels])).alias("ord", column)
    )
    return exploded


def md5_order(seed: int, stratum: Column | str, key: Column) -> Column:
    """A reproducible random order inside a stratum."""
    stratum = F.lit(stratum) if isinstance(stratum, str) else stratum
    return F.md5(F.concat_ws(":", F.lit(str(seed)), stratum, key))
