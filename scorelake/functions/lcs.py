"""Longest common subsequence of two token arrays, batched through Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a, b) -> int:
    """Bit-parallel length: bit i of ``row`` is 0 where a[:i+1] gains over a[:i]."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hits = row & where.get(token, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(x, y) for x, y in zip(a, b)], dtype="int64")


def register(spark: SparkSession) -> None:
    """Make the function callable from SQL as ``lcs_length``."""
    spark.udf.register("lcs_length", lcs_length)
