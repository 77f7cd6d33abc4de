"""Explicit schemas and the column guard every loader and operator uses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadweave import fixed_values as FV

# A post file as it lies on disk: every column is text, ids included.
RAW_POST_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FV.POST_COLUMNS])

EVIDENCE_TYPE = (
    "array<struct<customer_tweet_id:string,agent_tweet_id:string,"
    "customer_text:string,agent_text:string,similarity_score:double>>"
)


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Raise when a column is missing; looks at the schema only, runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df
