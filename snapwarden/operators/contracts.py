"""Data contracts: each frame is scanned for one row of facts, and the rules are judged on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.config import DatasetConfig

CHECKS = ("unique_columns", "business_keys", "key_nulls", "duplicate_keys", "required_columns", "metric_dtypes", "finite_measures", "week_progression", "latest_week_present", "null_fraction", "duplicate_fraction")


@dataclass(frozen=True)
class ContractCheck:
    name: str
    passed: bool
    detail: str


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def facts(df: DataFrame, keys: list[str], metrics: list[str], week: str) -> DataFrame:
    """One row of counts. Keys are grouped once; the per-key sums make the totals, so a hot key is summed before the shuffle.

    Duplicate keys are counted by groups, not by distinct counts, which would leave out null keys.
    """
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    numeric = [m for m in metrics if _numeric(df, m)]
    null = lambda c: F.col(c).isNull() | (F.isnan(F.col(c)) if isinstance(df.schema[c].dataType, T.DoubleType | T.FloatType) else F.lit(False))
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sum((F.count_if(null(m)) for m in metrics), F.lit(0)).alias("nulls"), sum((F.count_if(bad(m)) for m in numeric), F.lit(0)).alias("unfinite"))
    key_null = sum((F.when(F.col(k).isNull(), 1).otherwise(0) for k in keys), F.lit(0)) > 0
    whole = F.col(week).cast("double") if week in keys and _numeric(df, week) else F.lit(None).cast("double")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(
        total("n").alias("rows"), total(F.when(key_null, F.col("n"))).alias("key_nulls"), total(F.col("n") - 1).alias("duplicates"), total("nulls").alias("nulls"), total("unfinite").alias("unfinite"),
        total(F.when(F.col(week).isNull() if week in keys else F.lit(True), F.col("n"))).alias("week_nulls"), F.min(whole).alias("first_week"), F.max(whole).alias("last_week"), F.count_distinct(whole).alias("weeks"),
        F.coalesce(F.bool_and(whole == F.floor(whole)), F.lit(False)).alias("whole_weeks"),
    )


def frame_checks(df: DataFrame, config: DatasetConfig, stage: str | None = None, prefix: str = "") -> list[ContractCheck]:
    out: list[ContractCheck] = []
    add = lambda name, ok, detail="": out.append(ContractCheck(prefix + name, bool(ok), detail))
    unique = len(set(df.columns)) == len(df.columns)
    add("unique_columns", unique, "" if unique else "columns repeat")
    if not unique:
        return out
    week, keys = config.week_column, [config.week_column, *config.key_columns(stage)]
    missing = [k for k in keys if k not in df.columns]
    add("business_keys", not missing, f"missing: {missing}" if missing else "")
    here = [k for k in keys if k in df.columns]
    metrics = [m for m in config.metric_columns if m in df.columns]
    got = facts(df, here, metrics, week).first() if here else None
    if got is not None and not missing:
        add("key_nulls", got.key_nulls == 0, f"rows={got.key_nulls}")
        add("duplicate_keys", got.duplicates == 0, f"rows={got.duplicates}")
    absent = [c for c in config.required_columns if c not in df.columns]
    add("required_columns", not absent, f"missing: {absent}" if absent else "")
    text = [m for m in metrics if not _numeric(df, m)]
    add("metric_dtypes", not text, f"not numeric: {text}" if text else "")
    if got is None:
        return out
    add("finite_measures", got.unfinite == 0, f"cells={got.unfinite}")
    contiguous = got.rows and not got.week_nulls and got.whole_weeks and got.last_week - got.first_week + 1 == got.weeks
    add("week_progression", contiguous, f"weeks={got.weeks}")
    add("latest_week_present", got.rows and not got.week_nulls and week in df.columns)
    cells = got.rows * len(metrics)
    add("null_fraction", (got.nulls / cells if cells else 0.0) <= config.null_fraction_limit)
    add("duplicate_fraction", (got.duplicates / got.rows if got.rows else 0.0) <= config.duplicate_fraction_limit)
    return out


def validate(current: DataFrame, previous: DataFrame, config: DatasetConfig, stage: str | None = None) -> list[ContractCheck]:
    out = [*frame_checks(current, config, stage), *frame_checks(previous, config, stage, "previous:")]
    same = set(current.columns) == set(previous.columns)
    out.append(ContractCheck("compatible_schema", same, "" if same else f"differ: {sorted(set(current.columns) ^ set(previous.columns))}"))
    keys = [k for k in (config.week_column, *config.key_columns(stage)) if k in current.columns and k in previous.columns]
    kinds = [k for k in keys if _numeric(current, k) != _numeric(previous, k)]
    out.append(ContractCheck("compatible_key_types", not kinds, f"differ: {kinds}" if kinds else ""))
    return out


def status(checks: list[ContractCheck]) -> str:
    return "PASS" if all(c.passed for c in checks) else "DATA_CONTRACT_FAILURE"


def null_fraction(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg((sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)) / (F.count(F.lit(1)) * len(columns))).alias("null_fraction"))


def duplicate_fraction(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().agg((F.sum(F.col("count") - 1) / F.sum("count")).alias("duplicate_fraction"))
