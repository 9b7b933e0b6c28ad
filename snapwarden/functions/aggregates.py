"""Robust aggregates of groups as plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median, mad, n): the median and the median distance from it. Null values don't count."""
    known = df.where(F.col(value).isNotNull())
    middle = known.groupBy(*keys).agg(F.median(value).alias("median"), F.count(F.lit(1)).alias("n"))
    if not keys:
        return known.crossJoin(F.broadcast(middle)).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.count(F.lit(1)).alias("n"))
    joined = known.alias("d").join(middle.alias("m"), [F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])
    return joined.groupBy(*[F.col(f"d.{k}").alias(k) for k in keys]).agg(F.first("m.median").alias("median"), F.median(F.abs(F.col(f"d.{value}") - F.col("m.median"))).alias("mad"), F.first("m.n").alias("n"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, q01, q05 ...): interpolated quantiles, named by their percentage."""
    return df.groupBy(*keys).agg(*[F.percentile(value, p).alias(f"q{round(100 * p):02d}") for p in shares])


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, correlation): of the rows with both values; null where a side hardly varies (standard deviation of at most 1e-12)."""
    own = [F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y)]
    a, b = (F.stddev_pop(c) for c in own)
    return df.groupBy(*keys).agg(F.try_divide(F.covar_pop(*own), F.when((a > 1e-12) & (b > 1e-12), a * b)).alias("correlation"))
