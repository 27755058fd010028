"""User-defined functions at the edges. The operators themselves use built-in expressions only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectorised(fn, returns: str):
    """Scalar function over pandas Series, sent in Arrow batches."""

    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return fn(x)

    return run


def aggregate(fn, returns: str):
    """Series-to-scalar aggregate. A group is held in one task: pre-aggregate busy keys first."""

    @F.pandas_udf(returns)
    def run(x: pd.Series) -> float:
        return fn(x)

    return run


def per_group(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """applyInPandas for groups of bounded size (a game, a query)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def unroll_udtf():
    """Table function (sequence) -> (step, target, prefix) for lateral joins."""

    @F.udtf(returnType="step int, target bigint, prefix array<bigint>")
    class Unroll:
        def eval(self, seq):
            for i, target in enumerate(seq or []):
                yield i, target, list(seq[:i])

    return Unroll
