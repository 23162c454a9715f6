"""Combining one-row aggregates from several tables into one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_scalars(parts: list[DataFrame]) -> DataFrame:
    """Merge one-row frames with distinct bigint columns into a single row.

    Each table is aggregated on its own (partial + final aggregate, one small
    shuffle each); the one-row results are unioned as (name, value) pairs and
    folded back into columns, so no product of tables is ever formed.
    """
    names = [c for p in parts for c in p.columns]
    pairs = [p.selectExpr("inline(array(" + ", ".join(
        f"named_struct('k', '{c}', 'v', CAST({c} AS BIGINT))" for c in p.columns) + "))") for p in parts]
    long = reduce(DataFrame.unionByName, pairs)
    return long.agg(*[F.expr(f"max(CASE WHEN k = '{c}' THEN v END) AS {c}") for c in names])


def counts(df: DataFrame, **exprs: str) -> DataFrame:
    """One-row aggregate of SQL expressions (``name=expr``): one call per table, planned by Spark."""
    return df.agg(*[F.expr(f"{e} AS {n}") for n, e in exprs.items()])
