"""Onboarding: profile a table, propose settings, and try them on two versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.config import DatasetConfig, config_from
from snapwarden.sources.versions import VersionSource

WEEK_NAMES = ("week", "week_id", "week_no", "period", "week_end", "week_start", "yearweek")
METRIC_WORDS = ("dollar", "amount", "sales", "revenue", "units", "qty", "quantity", "scripts", "stock", "price", "value", "cost")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def infer_week(df: DataFrame, aliases: Mapping[str, str] | None = None) -> str | None:
    names = {(aliases or {}).get(c, c).strip().lower(): c for c in df.columns}
    exact = next((names[w] for w in WEEK_NAMES if w in names), None)
    return exact or next((c for n, c in names.items() if "week" in n or n.endswith("_dt")), None)


def split_columns(df: DataFrame, week: str | None, aliases: Mapping[str, str] | None = None) -> tuple[list[str], list[str]]:
    """Entity and measure columns: ids and texts are entities, other numbers measures."""
    entities, metrics = [], []
    for f in df.schema.fields:
        name = (aliases or {}).get(f.name, f.name).lower()
        if f.name == week or name.endswith("_count"):
            continue
        if name.endswith(("_id", "_key", "_code", "_no")) or (not is_numeric(f.dataType) and isinstance(f.dataType, T.StringType)):
            entities.append(f.name)
        elif is_numeric(f.dataType):
            metrics.append(f.name)
    return entities, sorted(metrics, key=lambda m: next((k for k, w in enumerate(METRIC_WORDS) if w in m.lower()), 99))


def profile(df: DataFrame, sample_rows: int = 100_000, count_rows: bool = True, aliases: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Schema, inferred roles and sampled null and duplicate shares. sample_rows bounds the profile, as a profile is to be quick; contracts look at all rows."""
    week = infer_week(df, aliases)
    entities, metrics = split_columns(df, week, aliases)
    sample = df.limit(sample_rows)
    nulls = sample.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first().asDict()
    keys = [c for c in (week, *entities) if c]
    repeats = sample.groupBy(*keys).count().agg(F.sum(F.col("count") - 1) / F.sum("count")).first()[0] if keys else None
    findings = [] if week else [{"check": "week_column", "severity": "error", "detail": "no week column was recognised"}]
    findings += [{"check": "metrics", "severity": "error", "detail": "no measure was recognised"}] if not metrics else []
    findings += [{"check": f"nulls:{c}", "severity": "warning", "detail": f"{v:.2%} null"} for c, v in nulls.items() if v]
    return {"schema": dict(df.dtypes), "week_column": week, "entity_columns": entities, "metric_columns": metrics, "rows": df.count() if count_rows else None, "null_share": nulls, "duplicate_share": repeats, "findings": findings}


def propose(found: Mapping[str, Any], name: str, rename: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings from a profile. rename: canonical → production name."""
    back = {v: k for k, v in (rename or {}).items()}
    canonical = lambda c: back.get(c, c)
    entities, metrics = [canonical(c) for c in found["entity_columns"]], [canonical(c) for c in found["metric_columns"]]
    if not found["week_column"] or not metrics:
        raise ValueError("a week column and a measure are needed")
    week = canonical(found["week_column"])
    return {"name": name, "week_column": week, "entity_columns": entities, "metric_columns": metrics, "primary_metric": metrics[0], "required_columns": [week, metrics[0]], "entity_key_columns": entities, "report_grain": [], "snapshot_metrics": [m for m in metrics[1:] if "stock" in m.lower()], "unit_value_metric": "dollar" if "dollar" in metrics else "", "unit_value_quantity": "units" if "units" in metrics else "", "count_entity_map": [], "hierarchy_columns": [], "hierarchy_intersections": [], "temporal_entity_columns": entities[:2], "explanation_entity_types": [e.removesuffix("_id") for e in entities], "column_map": sorted((rename or {}).items())}


def proposed_config(proposal: Mapping[str, Any]) -> DatasetConfig:
    return config_from(dict(proposal))


def try_versions(source: VersionSource, config: DatasetConfig, versions: Sequence[str] | None = None) -> dict[str, Any]:
    """A dry assessment of the last two versions: the status and what would have to be reviewed."""
    from snapwarden.plans.assess import assess

    previous, current = versions or source.list_versions()[-2:]
    result = assess(source, config, current, previous, with_manifest=False)
    return {"status": result.status, "review": [f"{f.check} {f.scope}: {f.outcome}" for f in result.findings if f.disposition in ("HARD_FAILURE", "UNEXPLAINED_ANOMALY")]}
