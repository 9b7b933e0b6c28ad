"""Reconstruction, reconciliation, hierarchy, lineage and reference checks."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import Executor
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig
from snapwarden.functions.aggregates import median_and_mad
from snapwarden.operators.cubes import aggregate, measures, zero_sum
from snapwarden.operators.fingerprints import fingerprint, fingerprint_deltas
from snapwarden.operators.lifecycle import EXTENDED, NEW_BACKFILL, NEW_RECENT, REMOVED, TRUNCATED
from snapwarden.operators.pairs import VersionPair


@dataclass(frozen=True)
class Check:
    name: str
    status: str  # PASS, FAIL, SKIPPED, NOT_APPLICABLE or UNSUPPORTED
    detail: str = ""


# --- counterfactual
def event_rows(events: DataFrame, classes: Sequence[str], weeks: str) -> DataFrame:
    """(entity_type, entity_id, week) of the events' weeks."""
    return events.where(F.col("classification").isin(*classes)).select("entity_type", "entity_id", F.explode(weeks).alias("_week"))


def _marked(df: DataFrame, rows: DataFrame, columns: Sequence[str], config: DatasetConfig, how: str) -> DataFrame:
    """df's rows that belong to none (left_anti) or to any (left_semi) of the events' entity weeks."""
    if how == "left_anti":
        for c in columns:
            own = rows.where(F.col("entity_type") == c.removesuffix("_id")).select(F.col("entity_id").alias("_e"), "_week")
            df = df.join(own, (F.col(c).cast("string") == F.col("_e")) & (F.col(config.week_column) == F.col("_week")), "left_anti")
        return df
    marks = []
    for k, c in enumerate(columns):
        own = rows.where(F.col("entity_type") == c.removesuffix("_id")).select(F.col("entity_id").alias(f"_e{k}"), F.col("_week").alias(f"_w{k}"), F.lit(True).alias(f"_m{k}")).distinct()
        df = df.join(own, (F.col(c).cast("string") == F.col(f"_e{k}")) & (F.col(config.week_column) == F.col(f"_w{k}")), "left")
        marks.append(F.coalesce(F.col(f"_m{k}"), F.lit(False)))
    out = df.where(reduce(or_, marks)) if marks else df.limit(0)
    return out.drop(*[f"_{x}{k}" for k in range(len(columns)) for x in "ewm"])


def counterfactual_cells(previous: DataFrame, current: DataFrame, events: DataFrame, config: DatasetConfig) -> DataFrame:
    """(keys, previous, current, adjusted): adjusted is current without added entity weeks and with removed ones restored.

    Three sides are tagged, united and grouped by key once, in place of a three-way outer join."""
    m, columns = config.primary_metric, [c for c in config.entity_columns if c in previous.columns and c in current.columns]
    kept = _marked(current, event_rows(events, (NEW_BACKFILL, NEW_RECENT, EXTENDED), "historical_weeks_added"), columns, config, "left_anti")
    back = _marked(previous, event_rows(events, (TRUNCATED, REMOVED), "historical_weeks_removed"), columns, config, "left_semi")
    keys = config.base_keys
    side = lambda df, k: df.select(*keys, F.col(m).alias("m"), F.lit(k).alias("side"))
    both = side(previous, 0).unionByName(side(current, 1)).unionByName(side(kept, 2)).unionByName(side(back, 2))
    at = lambda k: F.sum(F.when(F.col("side") == k, F.col("m")))
    cells = both.groupBy(*keys).agg(at(0).alias("previous"), at(1).alias("current"), at(2).alias("adjusted"))
    weeks = previous.select(config.week_column).distinct().join(current.select(config.week_column).distinct(), config.week_column, "left_semi")
    return cells.join(F.broadcast(weeks), config.week_column, "left_semi")


def counterfactual(previous: DataFrame, current: DataFrame, events: DataFrame, config: DatasetConfig) -> DataFrame:
    """One row: raw, explained and reconstructed delta, score, absolute residual, evaluated."""
    cells = counterfactual_cells(previous, current, events, config)
    p, c, a = (F.coalesce(x, F.lit(0.0)) for x in ("previous", "current", "adjusted"))
    gap = F.count_if(F.col("previous").isNull() | F.col("current").isNull() | F.col("adjusted").isNull())
    out = cells.agg(zero_sum(c - p).alias("raw_delta"), zero_sum(c - a).alias("explained_delta"), zero_sum(a - p).alias("reconstructed_delta"), zero_sum(F.abs(a - p)).alias("absolute_residual"), zero_sum(F.abs(p)).alias("scale"), zero_sum(p).alias("previous_total"), gap.alias("gaps"), F.count(F.lit(1)).alias("cells"))
    score = F.when(F.col("scale") > 1e-9, F.greatest(F.lit(0.0), 1 - F.col("absolute_residual") / F.col("scale"))).otherwise(F.when(F.col("absolute_residual") <= 1e-9, 1.0).otherwise(0.0))
    done = (F.col("cells") > 0) & ((F.lit(config.absent_entity_policy == "zero")) | (F.col("gaps") == 0))
    return out.select("raw_delta", "explained_delta", "reconstructed_delta", "absolute_residual", "previous_total", F.when(done, score).alias("score"), done.alias("evaluated"))


# --- reconciliation
def _align(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Outer alignment of two sums by tagged union; null where a side has no such key."""
    side = lambda df, k: df.select(*keys, *columns, F.lit(k).alias("_side"))
    both = side(left, 0).unionByName(side(right, 1))
    return both.groupBy(*keys).agg(*[F.sum(F.when(F.col("_side") == k, F.col(c))).alias(f"{c}_{n}") for c in columns for k, n in enumerate(names)], *[F.max(F.col("_side") == k).alias(f"has_{n}") for k, n in enumerate(names)])


def mass_balance(base: DataFrame, report: DataFrame, config: DatasetConfig) -> DataFrame:
    """Per measure: keys compared, worst relative residual, its key, and whether the grain is covered on both sides."""
    keys = [config.week_column, *config.report_grain]
    shared = [m for m in measures(base, config) if m in report.columns]
    cells = _align(base, report, keys, shared, ("base", "report"))
    cover = F.col("has_base") & F.col("has_report")
    parts = []
    for m in shared:
        b, r = F.coalesce(f"{m}_base", F.lit(0.0)), F.coalesce(f"{m}_report", F.lit(0.0))
        relative = F.abs(r - b) / F.when(F.abs(b) > 1e-9, F.abs(b)).otherwise(1.0)
        parts.append(F.struct(F.lit(m).alias("measure"), relative.alias("relative")))
    long = cells.select(*keys, cover.alias("covered"), F.explode(F.array(*parts)).alias("x")).select(*keys, "covered", "x.*")
    key = F.struct(*keys)
    return long.groupBy("measure").agg(F.count(F.lit(1)).alias("keys"), F.max("relative").alias("worst"), F.min_by(key, F.struct(-F.col("relative"), key)).alias("worst_key"), F.bool_and("covered").alias("covered"))


def count_mismatches(base: DataFrame, report: DataFrame, count: str, entity: str, config: DatasetConfig) -> DataFrame:
    """One row: report groups whose count differs from the distinct entities of the base."""
    keys = [config.week_column, *config.report_grain]
    expected = base.groupBy(*keys).agg(F.count_distinct(entity).alias("expected")).select(*[F.col(k).alias(f"_{k}") for k in keys], "expected")
    joined = report.join(expected, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return joined.agg(F.count_if(~F.col(count).cast("double").eqNullSafe(F.col("expected").cast("double")) | F.col(count).isNull()).alias("mismatched"))


def marker_rows(base: DataFrame, config: DatasetConfig) -> DataFrame:
    """Per hierarchy column: detail rows that hold the mark of a total. One scan for all columns."""
    columns = list(dict.fromkeys(c for group in config.hierarchy_columns for c in group if c in base.columns))
    marks = [m.lower() for m in config.hierarchy_total_markers]
    one = base.agg(*[F.count_if(F.lower(F.col(c).cast("string")).isin(*marks)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("marker_rows")) for c in columns])).alias("x")).select("x.*")


def unit_values(base: DataFrame, config: DatasetConfig) -> DataFrame:
    """(week, ratio): value per unit of each week with units."""
    sums = base.groupBy(F.col(config.week_column).alias("week")).agg(F.sum(config.unit_value_metric).alias("v"), F.sum(config.unit_value_quantity).alias("u"))
    return sums.where("u > 0").select("week", (F.col("v") / F.col("u")).alias("ratio"))


def price_outliers(base: DataFrame, config: DatasetConfig, periods: Sequence[int] | None) -> DataFrame:
    """Weeks whose value per unit is far from the median of the weeks before: (week, ratio, median, robust_z)."""
    ratios = unit_values(base, config)
    reference = tested = ratios
    if periods is not None:
        reference = ratios.where(F.col("week") < (min(periods) if periods else 0))
        if config.price_reference_weeks:
            reference = reference.orderBy(F.desc("week")).limit(config.price_reference_weeks)
        tested = ratios.where(F.col("week").isin(*periods)) if periods else ratios.limit(0)
    usable = median_and_mad(reference, [], "ratio").where((F.col("n") >= 5) & (F.col("mad") > 1e-9 * F.greatest(F.abs("median"), F.lit(1.0))))
    z = 0.6745 * (F.col("ratio") - F.col("median")) / F.col("mad")
    return tested.crossJoin(F.broadcast(usable)).select("week", "ratio", "median", z.alias("robust_z")).where(F.abs("robust_z") > config.price_outlier_k)


def reconcile(base: DataFrame | None, report: DataFrame | None, config: DatasetConfig, periods: Sequence[int] | None = None, same: bool = False) -> tuple[str, list[Check], list[dict[str, Any]]]:
    """Status, checks and price flags of one version."""
    if base is None or report is None:
        return "NOT_EVALUATED", [Check("mass_balance", "SKIPPED", "a stage is missing")], []
    checks, keys = [], [config.week_column, *config.report_grain]
    absent = [k for k in keys if k not in base.columns or k not in report.columns]
    if same:
        checks.append(Check("mass_balance", "NOT_APPLICABLE", "both stages are one frame"))
    elif absent:
        checks.append(Check("mass_balance", "SKIPPED", f"missing grain: {absent}"))
    else:
        one_sided = [m for m in config.metric_columns if (m in base.columns) != (m in report.columns)]
        checks += [Check(f"mass_balance:{m}", "SKIPPED", "in one stage only") for m in one_sided]
        for r in mass_balance(base, report, config).orderBy("measure").collect():
            if config.absent_entity_policy == "missing" and not r.covered:
                checks.append(Check(f"mass_balance:{r.measure}", "SKIPPED", "the grain isn't covered"))
            else:
                checks.append(Check(f"mass_balance:{r.measure}", "PASS" if r.worst <= config.reconciliation_tolerance else "FAIL", f"keys={r['keys']} worst={r.worst:.2e} at {tuple(r.worst_key)}"))
    for count, entity in config.count_entity_map:
        if count in report.columns and entity in base.columns:
            if absent:
                checks.append(Check(f"count_consistency:{count}", "SKIPPED", "the grain is missing"))
            else:
                n = count_mismatches(base, report, count, entity, config).first()[0]
                checks.append(Check(f"count_consistency:{count}", "FAIL" if n else "PASS", f"groups={n}"))
    if any(c in base.columns for group in config.hierarchy_columns for c in group):
        checks += [Check(f"aggregate_markers:{r.column}", "FAIL" if r.marker_rows else "PASS", f"rows={r.marker_rows}") for r in marker_rows(base, config).collect()]
    status = "RECONCILIATION_FAILURE" if any(c.status == "FAIL" for c in checks) else "PASS" if any(c.status == "PASS" for c in checks) else "NOT_EVALUATED"
    has = config.unit_value_metric in base.columns and config.unit_value_quantity in base.columns
    return status, checks, [r.asDict() for r in price_outliers(base, config, periods).orderBy("week").collect()] if has else []


# --- hierarchy
def levels(df: DataFrame, config: DatasetConfig) -> dict[str, tuple[str, ...]]:
    """Name of each level → its keys besides the week."""
    found: dict[str, tuple[str, ...]] = {"national": ()}
    found |= {c: (c,) for c in config.entity_columns if c in df.columns}
    return found | {"_x_".join(k): tuple(k) for k in config.hierarchy_intersections if k and all(c in df.columns for c in k)}


def hierarchy(df: DataFrame, config: DatasetConfig, distinct: bool = True) -> DataFrame:
    """All levels in one scan: (level, week, entity columns, measures, entity counts). Spark expands rows into grouping sets and sums before the shuffle."""
    week, found = config.week_column, levels(df, config)
    columns = list(dict.fromkeys(c for keys in found.values() for c in keys))
    counts = [F.count_distinct(entity).alias(count) for count, entity in config.count_entity_map if entity in df.columns] if distinct else []
    source = df.select(week, *[F.col(c).alias(f"k_{c}") for c in columns], *dict.fromkeys([*measures(df, config), *[e for _, e in config.count_entity_map if e in df.columns]]))
    sets = [[F.col(week), *[F.col(f"k_{c}") for c in keys]] for keys in found.values()]
    out = source.groupingSets(sets, F.col(week), *[F.col(f"k_{c}") for c in columns]).agg(F.grouping_id().alias("_set"), *[zero_sum(m).alias(m) for m in measures(df, config)], *counts)
    code = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys): name for name, keys in found.items()}
    level = F.coalesce(*[F.when(F.col("_set") == k, F.lit(n)) for k, n in code.items()])
    return out.select(level.alias("level"), week, *[F.col(f"k_{c}").alias(c) for c in columns], *measures(df, config), *[count for count, entity in config.count_entity_map if entity in df.columns and distinct])


def hierarchy_deviations(df: DataFrame, config: DatasetConfig) -> DataFrame:
    """(level, measure, null_key_rows, worst): worst relative deviation of a level's week totals from the national ones."""
    found, week = levels(df, config), config.week_column
    names = measures(df, config)
    cells = hierarchy(df, config, distinct=False)
    null_key = F.coalesce(*[F.when(F.col("level") == n, F.greatest(*[F.col(c).isNull() for c in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()) for n, keys in found.items() if keys], F.lit(False))
    totals = cells.groupBy("level", week).agg(*[zero_sum(m).alias(m) for m in names], F.count_if(null_key).alias("null_key_rows"))
    national = F.broadcast(totals.where("level = 'national'").select(F.col(week).alias("_w"), *[F.col(m).alias(f"n_{m}") for m in names]))
    compared = totals.where("level <> 'national'").join(national, F.col(week).eqNullSafe(F.col("_w")))
    long = compared.select("level", "null_key_rows", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), (F.abs(F.col(m) - F.col(f"n_{m}")) / F.greatest(F.abs(f"n_{m}"), F.lit(1.0))).alias("d")) for m in names])).alias("x"))
    return long.groupBy("level", F.col("x.measure").alias("measure")).agg(F.sum("null_key_rows").alias("null_key_rows"), F.max("x.d").alias("worst"))


def hierarchy_checks(df: DataFrame, config: DatasetConfig) -> list[Check]:
    out = []
    for r in hierarchy_deviations(df, config).orderBy("level", "measure").collect():
        if r.null_key_rows:
            out.append(Check(f"hierarchy_keys:{r.level}", "FAIL", f"rows={r.null_key_rows}"))
        out.append(Check(f"hierarchy_total:{r.level}:{r.measure}", "PASS" if r.worst <= config.reconciliation_tolerance else "FAIL", f"worst={r.worst:.3g}"))
    return list(dict.fromkeys(out))


def national_shares(df: DataFrame, columns: Sequence[str], config: DatasetConfig, through_week: int) -> DataFrame:
    """(series_id, share) of each child in the national total of the weeks that the child has, clamped to [0, 1]."""
    week, m = config.week_column, config.primary_metric
    own = df.where(F.col(week) <= through_week)
    parts = F.explode(F.array(*[F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]))
    child = own.select(F.col(week).alias("w"), F.col(m).alias("m"), parts.alias("series_id")).groupBy("series_id", "w").agg(zero_sum("m").alias("c"))
    total = F.broadcast(own.groupBy(F.col(week).alias("w2")).agg(zero_sum(m).alias("t")))
    sums = child.join(total, F.col("w") == F.col("w2")).groupBy("series_id").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    return sums.where("t > 0").select("series_id", F.least(F.greatest(F.col("c") / F.col("t"), F.lit(0.0)), F.lit(1.0)).alias("share"))


# --- lineage
def divergence(previous: DataFrame, current: DataFrame, keys: Sequence[str], weeks: Column, config: DatasetConfig) -> DataFrame:
    """One row: relative divergence by key over the compared weeks, and the difference in rows."""
    m = config.primary_metric
    cells = _align(previous.where(weeks).withColumn("_n", F.lit(1)), current.where(weeks).withColumn("_n", F.lit(1)), keys, [m, "_n"], ("previous", "current"))
    p, c = F.coalesce(f"{m}_previous", F.lit(0.0)), F.coalesce(f"{m}_current", F.lit(0.0))
    out = cells.agg(zero_sum(F.abs(c - p)).alias("a"), zero_sum(p).alias("t"), F.coalesce(F.sum(F.coalesce("_n_current", F.lit(0)) - F.coalesce("_n_previous", F.lit(0))), F.lit(0)).alias("row_count_delta"))
    relative = F.when(F.abs("t") > 1e-12, F.col("a") / F.abs("t")).when(F.col("a") <= 1e-9, 0.0)
    return out.select(relative.alias("relative_divergence"), "row_count_delta")


def week_revision(previous: DataFrame, current: DataFrame, weeks: Column, config: DatasetConfig) -> DataFrame:
    """(week, revision, scale): what each compared week gained, and the size of its previous total."""
    week, m = config.week_column, config.primary_metric
    tag = lambda df, sign: df.where(weeks).select(F.col(week).alias("week"), (F.col(m) * sign).alias("r"), (F.col(m) if sign < 0 else F.lit(None).cast("double")).alias("p"))
    return tag(previous, -1).unionByName(tag(current, 1)).groupBy("week").agg(zero_sum("r").alias("revision"), F.abs(zero_sum("p")).alias("scale"))


def entity_week_sums(df: DataFrame, column: str, config: DatasetConfig) -> DataFrame:
    """(entity_id, week, value): the primary measure of each entity of a column and week."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("entity_id"), F.col(config.week_column).alias("week")).agg(zero_sum(config.primary_metric).alias("value"))


def stage_increments(stages: Sequence[tuple[str, DataFrame, DataFrame]], weeks: Column, config: DatasetConfig) -> DataFrame:
    """(stage, position, increment): revision by week that a stage adds to the stage before, relative to its previous total."""
    week, m = config.week_column, config.primary_metric
    tag = lambda df, k, new: df.where(weeks).groupBy(F.col(week).alias("week")).agg(zero_sum(m).alias("m")).withColumns({"position": F.lit(k), "new": F.lit(new)})
    parts = [tag(df, k, new) for k, (_, p, c) in enumerate(stages) for new, df in ((False, p), (True, c))]
    cells = reduce(DataFrame.unionByName, parts).groupBy("position", "week").agg(F.sum(F.when(F.col("new"), F.col("m")).otherwise(-F.col("m"))).alias("revision"), F.coalesce(F.sum(F.when(~F.col("new"), F.abs("m"))), F.lit(0.0)).alias("scale"))
    before = Window.partitionBy("week").orderBy("position")
    inherited = F.when(F.lag("position").over(before) == F.col("position") - 1, F.lag("revision").over(before))
    added = cells.withColumn("own", F.abs(F.col("revision") - F.coalesce(inherited, F.lit(0.0))))
    sums = added.groupBy("position").agg(F.sum("own").alias("own"), F.sum("scale").alias("scale"))
    name = F.element_at(F.array(*[F.lit(s) for s, _, _ in stages]), F.col("position") + 1)
    return sums.select(name.alias("stage"), "position", F.when(F.col("scale") > 1e-12, F.col("own") / F.col("scale")).alias("increment"))


def lineage(stages: Sequence[tuple[str, DataFrame, DataFrame]], pair: VersionPair, config: DatasetConfig, pool: Executor | None = None) -> dict[str, Any]:
    """The stage where versions first diverge: the largest material increment, else the first stage that differs at all.

    With ``pool`` the stages' small results are computed side by side.
    """
    ordered = [s for name in config.pipeline_order for s in stages if s[0] == name]
    unmapped = [s[0] for s in stages if s[0] not in config.pipeline_order]
    if not ordered:
        return {"status": "UNKNOWN", "first_divergence": None, "divergences": [], "unmapped": unmapped}
    weeks = F.col(config.week_column).between(pair.overlap_start, pair.overlap_end - config.restatement_weeks)
    valued = [s for s in ordered if all(config.primary_metric in f.columns for f in s[1:])]
    increments = {r.stage: r.increment for r in stage_increments(valued, weeks, config).collect()} if valued else {}
    found = []

    def measured(stage: tuple[str, DataFrame, DataFrame]) -> tuple[Any, dict[str, float]]:
        name, p, c = stage
        keys = [config.week_column, *config.key_columns(name)]
        usable = all(k in f.columns for k in [*keys, config.primary_metric] for f in (p, c))
        d = divergence(p, c, keys, weeks, config).first() if usable else None
        own = [k for k in keys if k in p.columns and k in c.columns]
        sides = [fingerprint(f.where(weeks), config, own).withColumn("side", F.lit(i)) for i, f in enumerate((p, c))]
        before, after = (r.asDict() for r in sides[0].unionByName(sides[1], allowMissingColumns=True).orderBy("side").collect())
        return d, fingerprint_deltas(*({k: v for k, v in r.items() if k in s.columns and k != "side"} for r, s in zip((before, after), sides, strict=True)))

    for (name, _, _), (d, deltas) in zip(ordered, (pool.map if pool else map)(measured, ordered), strict=True):
        relative = d.relative_divergence if d else None
        changed = any(abs(v) > 1e-9 for v in deltas.values())
        rows = int(deltas.get("rows", 0))
        found.append({"stage": name, "row_count_delta": rows, "relative_divergence": relative, "increment": increments.get(name), "fingerprint_changed": changed, "diverged": changed or rows != 0 or relative is None or relative > config.lineage_materiality_ratio})
    material = {s: increments[s] for s, _, _ in ordered if (increments.get(s) or 0) > config.lineage_materiality_ratio}
    first = max(material, key=material.get) if material else next((x["stage"] for x in found if x["diverged"]), None)
    return {"status": "FIRST_DIVERGENCE" if first else "UNKNOWN" if unmapped else "PASS", "first_divergence": first, "divergences": found, "unmapped": unmapped}


# --- reference
@dataclass(frozen=True)
class ReferenceSpec:
    reference_id: str
    dataset: str
    metrics: tuple[str, ...]
    tolerance: float = 1e-6
    note: str = ""
    grain: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.reference_id or not self.dataset or not self.metrics or len(set(self.metrics)) != len(self.metrics) or len(set(self.grain)) != len(self.grain):
            raise ValueError("a reference needs an id, a dataset and distinct metrics and grain")
        if not 0 <= self.tolerance < float("inf"):
            raise ValueError("tolerance must be a number from 0 on")


def reference_cells(current: DataFrame, reference: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(measure, status inputs): totals, worst relative difference by key, and keys or values that one side lacks."""
    cells = _align(current, reference, keys, metrics, ("current", "reference"))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_current").alias("c"), F.col(f"{m}_reference").alias("r")) for m in metrics]))
    long = cells.select(rows.alias("x")).select("x.*")
    worst = F.max(F.abs(F.col("c") - F.col("r")) / F.greatest(F.abs("r"), F.lit(1e-9)))
    return long.groupBy("measure").agg(zero_sum("c").alias("current_total"), zero_sum("r").alias("reference_total"), worst.alias("relative_delta"), F.count_if(F.col("c").isNull() | F.col("r").isNull()).alias("uncovered"))


def compare_reference(current: DataFrame, reference: DataFrame, spec: ReferenceSpec, config: DatasetConfig) -> dict[str, Any]:
    keys = list(dict.fromkeys((config.week_column, *(spec.grain or config.report_grain))))
    usable = spec.dataset == config.name and all(k in f.columns for k in keys for f in (current, reference))
    shared = [m for m in spec.metrics if usable and m in current.columns and m in reference.columns]
    rows = {r.measure: r for r in reference_cells(current, reference, keys, shared).collect()} if shared else {}
    checks = []
    for m in spec.metrics:
        r = rows.get(m)
        if r is None or r.uncovered:
            checks.append({"metric": m, "status": "INCOMPLETE"})
        else:
            checks.append({"metric": m, "status": "MATCH" if r.relative_delta <= spec.tolerance else "MISMATCH", "current_total": r.current_total, "reference_total": r.reference_total, "relative_delta": r.relative_delta})
    kinds = {c["status"] for c in checks}
    return {"reference_id": spec.reference_id, "status": next(s for s in ("MISMATCH", "INCOMPLETE", "MATCH") if s in kinds), "checks": checks, "grain": keys}


def reference_mismatches(report: dict[str, Any] | None) -> list[str]:
    return [c["metric"] for c in report["checks"] if c["status"] == "MISMATCH"] if report and report["status"] == "MISMATCH" else []


def build_report(base: DataFrame, config: DatasetConfig) -> DataFrame:
    """The report stage: sums and distinct entity counts by week and report grain."""
    keys = config.headline_keys
    return base.groupBy(*keys).agg(*[zero_sum(m).alias(m) for m in measures(base, config)], *[F.count_distinct(e).alias(c) for c, e in config.count_entity_map if e in base.columns])


def level_aggregate(df: DataFrame, keys: Sequence[str], config: DatasetConfig) -> DataFrame:
    return aggregate(df, keys, config)
