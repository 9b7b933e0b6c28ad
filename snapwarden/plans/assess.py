"""One assessment of a pair of versions: every step a DataFrame plan that ends in a small result."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import Executor, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig
from snapwarden.functions.calendars import calendar_identity
from snapwarden.operators import attribution, checks, contracts, cubes, fingerprints, lifecycle, pairs, relationships
from snapwarden.plans import policy, series
from snapwarden.plans.approvals import RatioExpectation, apply_expectations, as_registry, observed_by
from snapwarden.sources.versions import CachedSource, VersionSource, mapped

MACHINE_SCHEMA = 8
#: Small results that the driver asks for side by side; each is a job of its own, so planning and short stages overlap.
SIDE_BY_SIDE = 6
#: Ids of each class and entity type, and replacements, that a report names with the number of the others; statuses and labels come from all rows.
SHOWN = 50


@dataclass
class Result:
    run_id: str
    dataset: str
    status: str = "INCOMPLETE"
    findings: list[policy.Finding] = field(default_factory=list)
    machine: dict[str, Any] = field(default_factory=dict)
    pair: pairs.VersionPair | None = None
    events: DataFrame | None = None
    cubes: dict[str, DataFrame] = field(default_factory=dict)
    temporal: DataFrame | None = None
    replacements: list[Any] = field(default_factory=list)
    provider: policy.DecisionProvider = field(default_factory=policy.RuleProvider)

    @property
    def requires_investigation(self) -> bool:
        return self.status not in ("PASS", "PASS_WITH_EXPLANATION")


def snapshot_manifest(source: VersionSource, versions: Sequence[str], config: DatasetConfig, pool: Executor | None = None) -> dict[str, Any]:
    """Digests of every stage and dimension of both versions, and the assessment's identity."""
    out: dict[str, Any] = {"config": fingerprints.digest(config.__dict__), "versions": {}}
    frames = {(v, s): source.read_fact(v, s) for v in versions for s in sorted(source.available_stages(v))}
    digests = dict(zip(frames, (pool.map if pool else map)(fingerprints.frame_digest, frames.values()), strict=True))
    for v in versions:
        own: dict[str, Any] = {"metadata": source.snapshot_metadata(v)}
        for s in sorted(source.available_stages(v)):
            own[s] = digests[v, s]
        for d in config.required_dimensions:
            frame = source.read_dim(v, d)
            own[f"dim:{d}"] = None if frame is None else fingerprints.frame_digest(frame)
        out["versions"][v] = own
    out["assessment_id"] = fingerprints.digest(out)[:24]
    return out


def assess(
    source: VersionSource, config: DatasetConfig, current: str | None = None, previous: str | None = None, registry: Any = None, reference: DataFrame | None = None, reference_spec: checks.ReferenceSpec | None = None,
    expectations: Sequence[RatioExpectation] = (), observed_at: str | None = None, run_id: str | None = None, with_manifest: bool = True,
    provider: policy.DecisionProvider | None = None,
) -> Result:
    cached = CachedSource(mapped(source, config), config)
    previous, current = pairs.select_versions(cached.list_versions(), current, previous)
    for v in (previous, current):
        ms = cached.snapshot_metadata(v).get("committed_ms")
        if observed_at and ms is not None and ms > datetime.fromisoformat(observed_at).timestamp() * 1000:
            raise ValueError(f"version {v!r} was committed after the observation time")
    out = Result(run_id or uuid.uuid4().hex[:12], config.name, provider=provider or policy.RuleProvider())
    out.machine = {"schema_version": MACHINE_SCHEMA, "run_id": out.run_id, "dataset": config.name, "observed_at": observed_at, "previous": previous, "current": current}
    kept: list[DataFrame] = []
    try:
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool, ThreadPoolExecutor(SIDE_BY_SIDE) as inner:
            if with_manifest:
                out.machine["manifest"] = snapshot_manifest(cached, (previous, current), config, pool)
            _run(out, cached, config, previous, current, as_registry(registry).events(), reference, reference_spec, expectations, observed_at, kept, pool, inner)
    finally:
        for df in kept:
            df.unpersist()
        cached.release()
    return out


def _finish(out: Result, config: DatasetConfig, facts: dict[str, Any]) -> None:
    out.findings = policy.with_options(out.findings, config.optional_checks)
    out.status = policy.status_of(out.findings)
    if config.decision_enabled:
        out.machine["decisions"] = out.provider.decide(policy.Evidence(**facts), config, out.status)
    out.machine |= {"status": out.status, "requires_investigation": out.requires_investigation, "findings": out.findings, "explained_by": {f.finding_id: list(f.approval_ids) for f in out.findings if f.outcome == "FAIL" and f.approval_ids}, "calendar": calendar_identity(config)}


def _run(out: Result, source: CachedSource, config: DatasetConfig, previous: str, current: str, registry: list[dict[str, Any]], reference: DataFrame | None, spec: checks.ReferenceSpec | None, expectations: Sequence[RatioExpectation], observed_at: str | None, kept: list[DataFrame], pool: Executor, inner: Executor) -> None:
    add = lambda *a, **k: out.findings.append(policy.Finding(*a, **k))
    name = config.name
    shared = sorted(set(source.available_stages(previous)) & set(source.available_stages(current)))
    if shared:  # a feed may lack the configured stages: the next in preference that both versions have is read
        stage, contract = pairs.common_stage(shared, shared, config.analysis_stages), pairs.common_stage(shared, shared, config.contract_stages)
    else:
        stage, contract = config.analysis_stage, config.contract_stage
    out.machine["stages"] = {"analysis": stage, "contract": contract}
    for d in config.required_dimensions:
        add(f"input:dimension:{d}", name, "PASS" if source.read_dim(previous, d) is not None and source.read_dim(current, d) is not None else "UNAVAILABLE")
    for s in dict.fromkeys((stage, contract)):
        add(f"input:stage:{s}", name, "PASS" if s in shared else "UNAVAILABLE")
    if stage not in shared:
        return _finish(out, config, {})

    failed = []
    both = [(s, source.read_fact(current, s), source.read_fact(previous, s)) for s in shared]
    for s, checked in zip(shared, pool.map(lambda x: contracts.validate(x[1], x[2], config, x[0]), both), strict=True):
        for c in checked:
            add(f"contracts:{s}:{c.name}", name, "PASS" if c.passed else "CONTRACT_FAILURE", detail=c.detail)
            failed += [] if c.passed else [f"{s}:{c.name}"]
    if failed:
        return _finish(out, config, {"failed_contracts": tuple(failed)})

    p, c = source.typed(previous, stage), source.typed(current, stage)
    pair = out.pair = pairs.build_pair(p, c, config, previous, current, stage, stage)
    out.machine["pair"] = pair
    latest = pair.current_max_week
    # what depends on the facts alone is asked for now and read where it is reported
    report = source.typed(current, contract) if contract in shared else None
    sides = [(s, source.typed(previous, s), source.typed(current, s)) for s in shared]
    merges = relationships.replacements(p, c, pair, config, kept=kept).persist(StorageLevel.MEMORY_AND_DISK)
    kept.append(merges)
    merging = pool.submit(lambda: [r.asDict() for r in merges.orderBy("entity_type", "source_id", "target_id").limit(SHOWN).collect()])
    tracing = pool.submit(checks.lineage, sides, pair, config, inner)
    reconciling = pool.submit(checks.reconcile, c, report, config, pair.new_periods, contract == stage)
    ranking = pool.submit(checks.hierarchy_checks, c, config)
    grains = {"base": config.base_keys, "headline": config.headline_keys, "week": [config.week_column]}
    for grain, keys in grains.items():
        if all(k in f.columns for k in keys for f in (p, c)):
            out.cubes[grain] = cubes.revision_cube(p, c, keys, config, pair.new_periods).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(out.cubes[grain])
        else:
            add("revision_missing_evidence", grain, "UNAVAILABLE")
    cube = out.cubes["base"]
    cells = [x for x in cube.columns if x.endswith(("_previous", "_current"))]
    if cube.where(" or ".join(f"`{x}` is null" for x in cells)).limit(1).count():
        add("revision_missing_evidence", "base", "UNAVAILABLE")

    dims = [source.read_dim(v, "products") for v in (previous, current)]
    events = lifecycle.all_events(p, c, pair, config, *dims).persist(StorageLevel.MEMORY_AND_DISK)
    kept.append(events)
    out.events = events
    out.replacements = merging.result()
    approved = attribution.registry_frame(c.sparkSession, [e for e in registry if observed_by(e, observed_at)], config)
    matched = attribution.match_approvals(events, approved, config, latest).persist(StorageLevel.MEMORY_AND_DISK)
    kept.append(matched)
    kind = attribution.explanation_type(events, config)
    a = attribution.explain(cube, matched, config, kind)
    a["contributors"] = cubes.contributors(cube, f"{kind}_id" if kind and f"{kind}_id" in cube.columns else config.base_keys[1], config).collect() if len(config.base_keys) > 1 else []
    threshold = max(config.materiality_abs, config.materiality_ratio * abs(a["previous_total"]))

    # like for like: approved closures and moves no longer move the comparison
    standing = attribution.standing_closures(c, approved, latest, config).select("entity_type", "entity_id")
    closures = matched.where("absence_approval is not null").select("entity_type", "entity_id").unionByName(standing).distinct()
    has_moves = "details" in matched.columns
    moves = matched.where((F.col("classification") == lifecycle.RECLASSIFIED) & F.col("approval").isNotNull()).select(F.explode("details.products").alias("product_id"), "details.from_commodity", "details.to_commodity") if has_moves else None
    restated = bool(closures.limit(1).count()) or (moves is not None and bool(moves.limit(1).count()))
    lp, lc = attribution.like_for_like(p, c, closures, moves) if restated else (p, c)
    changes = lifecycle.entity_changes(lp, lc, pair, config) if restated else events
    unexplained = changes.join(matched.where("absence_approval is not null").select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_anti")
    known = attribution.explained_closures(approved, pair.previous_min_week, pair.previous_max_week).select("entity_type", "entity_id")
    baseline = lifecycle.absence_baseline(attribution.without_entities(lp, known), config)
    impact = lifecycle.missing_impact(unexplained, config, baseline).collect()
    material_types = [r.entity_type for r in impact if r.material]

    rebuilt = checks.counterfactual(p, c, events, config).first() if a["structural"] else None
    history, reason = attribution.assess_history("PASS", a, bool(material_types), config, rebuilt.score if rebuilt and rebuilt.evaluated else None)
    out.machine |= {"historical_revision": {"status": history, "reason": reason}, "attribution": a, "missing_entities": impact, "materiality_threshold": threshold, "counterfactual": rebuilt}
    if history != "PASS":
        ids = tuple(r[0] for r in matched.where("approval is not null").select("approval").distinct().orderBy("approval").collect()) if history == "PASS_WITH_EXPLANATION" else ()
        add("historical_revision", name, "FAIL", approval_ids=ids)
    if rebuilt and rebuilt.evaluated:
        add("counterfactual_residual", name, "FAIL" if rebuilt.absolute_residual > threshold else "PASS", impact=rebuilt.absolute_residual, materiality=threshold)
    weeks = attribution.week_revisions(cube, events, config, kind).where("material").orderBy("week").collect()
    for r in weeks:
        add("revision_week", str(r.week), "FAIL", metric=config.primary_metric, period=r.week, impact=abs(r.unexplained), materiality=r.tolerance * abs(r.previous))
    for r in matched.where("approval is not null or absence_approval is not null").select("entity_type", "entity_id", "classification", "approval", "absence_approval").orderBy("entity_type", "entity_id").collect():
        for check, approval in (("historical_event", r.approval), ("absence_event", r.absence_approval)):
            if approval:
                add(check, f"{r.entity_type}:{r.entity_id}:{r.classification}", "FAIL", approval_ids=(approval,))

    state, found, flags = reconciling.result()
    for x in found:
        add(f"reconciliation:{x.name}", name, {"SKIPPED": "UNAVAILABLE", "NOT_APPLICABLE": "SKIPPED"}.get(x.status, x.status), required=x.status != "NOT_APPLICABLE", detail=x.detail)
    audit = apply_expectations([{"metric": "dollar_per_unit", "week": f["week"], "ratio": f["ratio"]} for f in flags], expectations, name, observed_at, c.sparkSession)
    for f in audit["expected"] + audit["unexpected"]:
        add("ratio:dollar_per_unit", str(f["week"]), "FAIL", approval_ids=(f["explained_by"],) if "explained_by" in f else (), period=f["week"])
    for x in ranking.result():
        add(x.name, x.name.split(":")[1], x.status, detail=x.detail)
    trail = tracing.result()
    add("lineage", name, "UNAVAILABLE" if trail["status"] == "UNKNOWN" else "PASS", required=False)
    if reference is not None and spec is not None:
        control = checks.compare_reference(report if report is not None else c, reference, spec, config)
        out.machine["reference"] = control
        add("reference", spec.reference_id, {"MATCH": "PASS", "MISMATCH": "FAIL", "INCOMPLETE": "UNAVAILABLE"}[control["status"]])
    out.machine |= {"reconciliation": {"status": state, "ratio_flags": flags}, "expectations": audit, "lineage": trail, "replacements": out.replacements}

    anomalies = _latest(out, lp, lc, changes, pair, config, kept) if config.temporal_enabled and pair.new_periods else []
    if config.temporal_enabled and not pair.new_periods:
        for m in config.temporal_metrics:
            add("temporal", name, "UNAVAILABLE", metric=m, required=config.temporal_required and m in config.required_temporal_metrics)
    every, moved = event_groups(events), F.col("classification") == lifecycle.RECLASSIFIED
    out.machine["events"] = {"counts": {k: sum(g.count for g in every if g.classification == k) for k in sorted({g.classification for g in every})}, "shown": {k: [(g.entity_type, i) for g in every if g.classification == k for i in g.ids] for k in sorted({g.classification for g in every})}}
    taken = merges.select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    if "details" in events.columns:
        taken = taken.unionByName(events.where(moved).select(F.explode(F.array("details.from_commodity", "details.to_commodity")).alias("entity_id")))
    free = event_groups(events.where(~moved).join(taken.distinct(), "entity_id", "left_anti"))
    facts = {"events": free, "merged": tuple((r["source_id"], r["target_id"]) for r in out.replacements), "n_merged": merges.count(), "moves": tuple(g for g in every if g.classification == lifecycle.RECLASSIFIED)}
    _finish(out, config, facts | {"material_absences": tuple(material_types), "attribution": a, "unmatched": a["unmatched"], "restated_weeks": tuple(r.week for r in weeks), "first_divergence": trail["first_divergence"], "anomalies": tuple(anomalies)})


def event_groups(events: DataFrame, shown: int = SHOWN) -> tuple[policy.Group, ...]:
    """All events by class and entity type, with their number and the first ids of each: a few rows come to the driver, whatever the events are."""
    keys = ["classification", "entity_type"]
    counts = {(r.classification, r.entity_type): r["count"] for r in events.groupBy(*keys).count().collect()}
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("entity_id"))
    first = events.select(*keys, "entity_id").withColumn("place", place).where(F.col("place") <= shown).orderBy(*keys, "place").collect()
    return tuple(policy.Group(k, t, n, tuple(r.entity_id for r in first if (r.classification, r.entity_type) == (k, t))) for (k, t), n in sorted(counts.items()))


def _latest(out: Result, previous: DataFrame, current: DataFrame, events: DataFrame, pair: pairs.VersionPair, config: DatasetConfig, kept: list[DataFrame]) -> list[str]:
    """Findings on the appended periods; the ids of anomalous series."""
    for m in config.temporal_metrics:
        if m not in current.columns:
            out.findings.append(policy.Finding(f"input:metric:{m}", config.name, "UNAVAILABLE", metric=m, required=m in config.required_temporal_metrics))
    out.temporal = series.assess_latest(previous, current, pair, events, config).persist(StorageLevel.MEMORY_AND_DISK)
    kept.append(out.temporal)
    rows = out.temporal.select("metric", "series_id", "level", "target", "reason", "required", "anomaly", "flags", "share_impact", "residual", "materiality", "adjusted_p", "actual", "point").orderBy("metric", "target", "series_id").collect()  # one row per configured series
    for r in rows:
        needed = config.temporal_required and (r.metric in config.required_temporal_metrics)
        if r.reason is not None:
            out.findings.append(policy.Finding("temporal", r.series_id, "UNAVAILABLE", required=needed and r.required, metric=r.metric, level=r.level, period=r.target, detail=r.reason))
        else:
            out.findings.append(policy.Finding("temporal", r.series_id, "FAIL" if r.anomaly else "PASS", metric=r.metric, level=r.level, period=r.target, impact=r.share_impact if r.share_impact is not None else r.residual, materiality=r.materiality))
    found = [r for r in rows if r.anomaly]
    out.machine["temporal"] = {"series": len(rows), "anomalies": [r.asDict() for r in sorted(found, key=lambda r: (r.adjusted_p, -abs(r.residual / r.point) if r.point else 0.0))], "sensitivity": series.sensitivity(out.temporal, config)}
    return [r.series_id for r in found]
