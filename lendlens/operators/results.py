"""Set and ordering operators at the end of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """Concatenation; duplicates are kept."""
    return first.unionByName(second)


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending, NULL first."""
    return df.orderBy(*(F.asc_nulls_first(name) for name in columns))
