"""Joins of many rows with one fact per key, where a key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread_by: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per key).

    A key's rows are dealt over ``salts`` places by a hash of ``spread_by``, and each fact is repeated for
    every place, so no task gets a hot key as a whole. Facts are few against rows: one per key.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [*keys, "_salt"]).drop("_salt")
