"""Measured sizes, to decide on broadcasts and literals by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_bytes(df: DataFrame) -> Column:
    """About the size of a row: the bytes of its texts and other values of no fixed width, 16 for each column."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    texts = [F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in texts]
    return sum(sizes, F.lit(16 * len(df.columns)).cast("bigint"))
