"""Loops of assessments over generated scenarios: a shadow run, a registered cohort, a sweep of fault sizes, a replay."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from snapwarden.config import DatasetConfig, replaced
from snapwarden.evaluate.scores import EvaluationCase, gates, metrics
from snapwarden.functions.jsonutil import dumps
from snapwarden.operators.fingerprints import digest
from snapwarden.plans.assess import Result, assess
from snapwarden.sources.versions import FrameSource
from snapwarden.world.faults import SPECS, Scenario, build

#: Cause labels that a family's truth accepts.
CAUSE_OF = {"missing_stores": "MISSING_STORES", "missing_products": "MISSING_PRODUCTS", "new_store_backfill": "BACKFILL", "history_truncation": "HISTORICAL_CORRECTION", "commodity_remap": "RECLASSIFICATION", "coding_error": "CODING", "warehouse_transform_error": "WAREHOUSE", "recalculation": "HISTORICAL_CORRECTION", "schema_failure": "SCHEMA_FAILURE", "null_duplicate_storm": "SCHEMA_FAILURE", "entity_merge": "ENTITY_MERGE", "week_restatement": "HISTORICAL_CORRECTION"}


def config_for(profile: str) -> DatasetConfig:
    tiny = profile == "tiny"
    return replaced(DatasetConfig(), name=f"{profile}-retail", temporal_min_history=12 if tiny else 26, metric_columns=("dollar", "units", "scripts", "stock"), restatement_weeks=2 if profile == "realistic" else 0)


def assess_scenario(s: Scenario, config: DatasetConfig) -> Result:
    """Assess with the scenario's own registry; the truth stays with the caller."""
    entries = [{**e, "dataset": config.name} for e in s.case.registry]
    return assess(FrameSource(s.facts, s.dims), config, registry=entries, with_manifest=False)


def score(s: Scenario, r: Result, case_id: str) -> EvaluationCase:
    actionable = s.spec.status not in ("PASS", "PASS_WITH_EXPLANATION")
    decided = r.machine.get("decisions", {}).get("likely_cause", {}).get("value")
    return EvaluationCase(case_id, case_id, actionable, r.requires_investigation, 0 if r.requires_investigation else None, CAUSE_OF.get(s.family), decided)


def run_shadow(spark: SparkSession, families: Iterable[str], profile: str = "tiny", seeds: Sequence[int] = (7,), config: DatasetConfig | None = None) -> dict[str, Any]:
    config, cases, records = config or config_for(profile), [], []
    for seed in seeds:
        for family in families:
            s = build(spark, family, profile, seed)
            r = assess_scenario(s, config)
            cases.append(score(s, r, f"{family}-{seed}"))
            records.append({"case": cases[-1].case_id, "family": family, "status": r.status, "expected": s.spec.status, "first_divergence": (r.machine.get("lineage") or {}).get("first_divergence"), "expected_origin": s.spec.origin})
    return {"profile": profile, "seeds": list(seeds), "records": records, "status_matches": sum(r["status"] == r["expected"] for r in records), "metrics": metrics(cases), "cases": [asdict(c) for c in cases]}


def run_cohort(spark: SparkSession, plan: dict[str, Any], plan_sha256: str | None = None) -> dict[str, Any]:
    """A plan that was fixed before: profile, seeds, families, gates. A plan that differs from its hash is refused."""
    if plan_sha256 is not None and digest(plan) != plan_sha256:
        raise ValueError("the plan differs from the registered one")
    out = run_shadow(spark, plan["families"], plan["profile"], plan["seeds"])
    cases = [EvaluationCase(**c) for c in out["cases"]]
    return out | {"plan": plan, "gates": gates(cases, plan["minimum_detection"], plan["maximum_false_positive"], plan.get("maximum_clearance"))}


def run_sweep(spark: SparkSession, families: Sequence[str], magnitudes: Sequence[float], profile: str = "tiny", seeds: Sequence[int] = (7,), controls: int = 1) -> list[dict[str, Any]]:
    from snapwarden.world.faults import relative_effect

    config, rows = config_for(profile), []
    for seed in seeds:
        for family, size in [*[(f, m) for f in families for m in magnitudes], *[("clean", 0.0)] * controls]:
            s = build(spark, family, profile, seed, size or None)
            r = assess_scenario(s, config)
            rows.append({"family": family, "magnitude": float(size), "seed": seed, "flagged": r.requires_investigation, "status": r.status, "effect": relative_effect(s.clean, s.facts["V0002"]) if family not in ("clean", "schema_failure") else 0.0})
    return rows


def write_results(value: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(json.dumps(r) for r in value) + "\n" if path.endswith(".jsonl") else dumps(value, indent=1), encoding="utf-8")


def all_families() -> list[str]:
    return [*SPECS]
