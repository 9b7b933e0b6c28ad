"""Experiments on feeds of real shape: cases over weeks, what counts as detected, event alarms, rules for shares, sequences.

A feed is one table (week, store_id, product_id, parents, measures); the refresh of week k has all weeks up to k.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig
from snapwarden.evaluate.scores import rate
from snapwarden.operators.relationships import benjamini_hochberg
from snapwarden.plans.assess import Result, assess
from snapwarden.plans.policy import FIELDS, STATUSES
from snapwarden.sources.versions import FrameSource

# --- cases and detection
#: Where the check that should see a fault leaves its trace.
SEEN_BY: dict[str, tuple[str, ...]] = {"missing_stores": ("missing", "store"), "missing_products": ("missing", "product"), "market_movement": ("series", "commodity_id"), "week_restatement": ("check", "historical_revision", "revision_week"), "recalculation": ("check", "historical_revision", "revision_week")}
Fault = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Case:
    week: int
    family: str = "clean"
    fault: Fault | None = None
    target: str = ""
    variant: str = ""


def cases(weeks: Sequence[int], faults: Mapping[str, Fault], stride: int = 5, targets: Mapping[str, str] | None = None) -> list[Case]:
    """A clean case for every week, and each fault at every stride-th week."""
    return [Case(w) for w in weeks] + [Case(w, name, fault, (targets or {}).get(name, "")) for name, fault in faults.items() for w in weeks[::stride]]


def review_checks(machine: Mapping[str, Any]) -> list[str]:
    """Checks with an open finding."""
    return sorted({f.check for f in machine.get("findings", []) if f.disposition in ("HARD_FAILURE", "UNEXPLAINED_ANOMALY")})


def detected(case: Case, result: Result) -> bool:
    """Whether the check that should see the case's fault raised it."""
    if result.status == "PASS":
        return False
    how, *what = SEEN_BY.get(case.family, ("any",))
    if how == "missing":
        return any(r.entity_type in what and r.material for r in result.machine.get("missing_entities", []))
    if how == "series":
        return any(r["series_id"] == f"{what[0]}:{case.target}" for r in result.machine.get("temporal", {}).get("anomalies", []))
    return how == "any" or bool(set(what) & set(review_checks(result.machine)))


def run_case(feed: DataFrame, case: Case, config: DatasetConfig) -> dict[str, Any]:
    """Assess the refresh of the case's week against the one before, with its fault in the newer version."""
    week = F.col(config.week_column)
    now = feed.where(week <= case.week)
    now = case.fault(now, case.week) if case.fault else now
    r = assess(FrameSource({"before": {config.analysis_stage: feed.where(week < case.week)}, "now": {config.analysis_stage: now}}, {}), config, with_manifest=False)
    return {"week": case.week, "family": case.family, "variant": case.variant, "status": r.status, "detected": detected(case, r), "checks": review_checks(r.machine), "history_reason": r.machine.get("historical_revision", {}).get("reason", ""), "material": [x.entity_type for x in r.machine.get("missing_entities", []) if x.material], "absences": {}}


def score(records: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    """Rates by family and variant: alarms of clean cases, detections of the others."""
    groups: dict[str, list[bool]] = {}
    for r in records:
        name = r["family"] + (f"@{r['variant']}" if r.get("variant") else "")
        groups.setdefault(name, []).append(r["status"] != "PASS" if r["family"] == "clean" else bool(r["detected"]))
    return {name: rate(sum(hits), len(hits)) for name, hits in sorted(groups.items())}


# --- absences that are real
def real_absences(feed: DataFrame, week: int, columns: Sequence[str], config: DatasetConfig) -> DataFrame:
    """(entity_type, entity_id, first_week): entities with rows in the week before and none in the week."""
    at = F.col(config.week_column)
    each = F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_id")).alias("entity_type"), F.col(c).cast("string").alias("entity_id")) for c in columns]))
    seen = feed.where(at <= week).select(each.alias("e"), at.alias("w")).groupBy("e.entity_type", "e.entity_id").agg(F.min("w").alias("first_week"), F.max(F.when(F.col("w") == week - 1, 1).otherwise(0)).alias("before"), F.max(F.when(F.col("w") == week, 1).otherwise(0)).alias("now"))
    return seen.where("before = 1 and now = 0 and entity_id is not null").select("entity_type", "entity_id", "first_week")


def real_event_alarm(record: Mapping[str, Any], types: Sequence[str]) -> bool:
    """Whether a clean case's alarm is about entities that did leave the feed: nothing else is open, and all material types really lost some."""
    only = record["status"] != "PASS" and list(record["checks"]) == ["historical_revision"] and record.get("history_reason") == "missing_entities"
    return only and bool(record["material"]) and all(t in types and record["absences"].get(t) for t in record["material"])


def coverage_registry(feed: DataFrame, column: str, config: DatasetConfig, approved_by: str = "coverage") -> list[dict[str, Any]]:
    """Entries that explain entities whose first week is later than the feed's: one for each first week. One row per week comes to the driver."""
    week = F.col(config.week_column)
    first = feed.groupBy(F.col(column).cast("string").alias("id")).agg(F.min(week).alias("first"))
    start = feed.agg(F.min(week)).first()[0]
    rows = first.where(F.col("first") > F.lit(start)).groupBy("first").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("first").collect()
    kind = column.removesuffix("_id")
    return [{"event_id": f"coverage-{kind}-{r['first']}", "dataset": config.name, "classification": "NEW_ENTITY_RECENT", "entity_type": kind, "entity_ids": r.ids, "expected_history_start": r["first"], "expected_history_end": r["first"], "confirmed": True, "approved_by": approved_by} for r in rows]


# --- rules for shares
def add_share_rules(tests: DataFrame) -> DataFrame:
    """tests (series_id, week, trailing_p, seasonal_p, p) with one p-value for each rule: the test in use, each alone, the larger, and twice the smaller."""
    both = F.col("trailing_p").isNotNull() & F.col("seasonal_p").isNotNull()
    return tests.withColumns({
        "current": F.col("p"), "trailing": F.coalesce("trailing_p", "p"), "seasonal": F.coalesce("seasonal_p", "p"),
        "larger": F.when(both, F.greatest("trailing_p", "seasonal_p")).otherwise(F.col("p")), "bonferroni": F.when(both, F.least(F.lit(1.0), 2 * F.least("trailing_p", "seasonal_p"))).otherwise(F.col("p")),
    })


def score_share_rule(tests: DataFrame, rule: str, q: float, planted: str = "planted") -> DataFrame:
    """(week, planted, tests, found): discoveries of a rule, one family of tests a week."""
    found = benjamini_hochberg(tests, q, rule, ["week"])
    return found.groupBy("week", planted).agg(F.count(F.lit(1)).alias("tests"), F.count_if("significant").alias("found"))


# --- sequences of refreshes
@dataclass
class Refreshes:
    """Refreshes of one feed, each with the fault that the sequence has reached by then."""

    kind: str
    steps: list[tuple[int, float]] = field(default_factory=list)


def sequence(kind: str, first_week: int, size: float, refreshes: int = 10) -> Refreshes:
    """"drift": the fault grows by equal parts to its size; "step": it is there in full from the middle on; "clean": never."""
    part = {"drift": lambda k: size * (k + 1) / refreshes, "step": lambda k: size if k >= refreshes // 2 else 0.0, "clean": lambda k: 0.0}
    if kind not in part:
        raise ValueError(f"unknown sequence {kind!r}")
    return Refreshes(kind, [(first_week + k, part[kind](k)) for k in range(refreshes)])


def replay(feed: DataFrame, plan: Refreshes, fault: Callable[[DataFrame, int, float], DataFrame], config: DatasetConfig, registry: Sequence[Mapping[str, Any]] = ()) -> list[dict[str, Any]]:
    """Assess one refresh after another; the version before has what the fault did to it."""
    week, out, before = F.col(config.week_column), [], None
    for at, size in plan.steps:
        now = fault(feed.where(week <= at), at, size) if size else feed.where(week <= at)
        if before is not None:
            r = assess(FrameSource({"before": {config.analysis_stage: before}, "now": {config.analysis_stage: now}}, {}), config, registry=[dict(e) for e in registry], with_manifest=False)
            out.append({"kind": plan.kind, "week": at, "size": size, "status": r.status, "flagged": r.requires_investigation, "approved": r.status == "PASS_WITH_EXPLANATION"})
        before = now
    return out


def summarise_sequences(rows: Iterable[Mapping[str, Any]]) -> dict[str, Any]:
    """By kind: refreshes flagged, and after how many the first was."""
    out: dict[str, Any] = {}
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        out[kind] = {"flagged": rate(sum(bool(r["flagged"]) for r in own), len(own)), "first": next((k for k, r in enumerate(own, 1) if r["flagged"]), None)}
    return out


def approvals_effect(without: Sequence[Mapping[str, Any]], with_entries: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    """What a registry changes: refreshes that were flagged and are explained with it, and those it leaves flagged."""
    pairs = [*zip(without, with_entries, strict=True)]
    flagged = [(a, b) for a, b in pairs if a["flagged"]]
    return {"cleared": rate(sum(b["status"] == "PASS_WITH_EXPLANATION" for _, b in flagged), len(flagged)), "still_flagged": sum(bool(b["flagged"]) for _, b in flagged), "newly_flagged": sum(bool(b["flagged"]) and not a["flagged"] for a, b in pairs)}


# --- features of an assessment
def features(result: Result) -> dict[str, float]:
    """Numbers that a learned labeller may read: status, events, revision, stages, series and open findings."""
    m = result.machine
    a, trail, series = m.get("attribution") or {}, m.get("lineage") or {}, (m.get("temporal") or {}).get("anomalies", [])
    total = abs(a.get("previous_total") or 0.0) or 1.0
    log = lambda x: math.log10(max(x, 1e-12)) if x else -12.0
    out = {f"status:{s}": float(result.status == s) for s in STATUSES}
    out |= {f"events:{k}": float(n) for k, n in (m.get("events") or {}).get("counts", {}).items()}
    out |= {f"missing_share:{r.entity_type}": float(r.share or 0.0) for r in m.get("missing_entities", [])} | {f"missing_material:{r.entity_type}": float(r.material) for r in m.get("missing_entities", [])}
    out |= {"revision_relative": (a.get("raw_delta") or 0.0) / total, "unexplained_relative": (a.get("unexplained_delta") or 0.0) / total} | {k: float(a.get(k) or 0.0) for k in ("explained_fraction", "material", "breadth", "over_explained", "offsetting", "structural")}
    rebuilt = m.get("counterfactual")
    out["reconstruction_score"] = float(rebuilt.score) if rebuilt and rebuilt.score is not None else -1.0
    out |= {f"origin:{s}": float(trail.get("first_divergence") == s) for s in ("source", "coded", "warehouse", "report")} | {f"increment_log:{d['stage']}": log(d.get("increment")) for d in trail.get("divergences", [])}
    out |= {f"anomalies:{k}": float(sum(r["level"] == k for r in series)) for k in sorted({r["level"] for r in series})}
    out["replacements"], out["price_flags"] = float(len(result.replacements)), float(len((m.get("reconciliation") or {}).get("ratio_flags", [])))
    return out | {f"fails:{c}": 1.0 for c in review_checks(m)}


def label_of(result: Result) -> str:
    return result.machine.get("decisions", {}).get("likely_cause", {}).get("value", FIELDS["likely_cause"][1][-1])
