"""Fault families: what each does to the stages of the current version, and the truth about it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapwarden.operators.lifecycle import NEW_BACKFILL
from snapwarden.world.generate import STAGES, PROFILES, coded, dimensions, normal, report, truth, uniform, warehouse, week_table, with_late_arrivals


@dataclass(frozen=True)
class Spec:
    """Expected outcome of a family: its stage, kind, status, class and origin."""

    stage: str
    kind: str
    status: str
    klass: str
    origin: str | None


SPECS: dict[str, Spec] = {
    "missing_stores": Spec("source", "fault", "INVESTIGATE", "missing_stores", "source"), "missing_products": Spec("source", "fault", "INVESTIGATE", "missing_products", "source"), "new_store_backfill": Spec("source", "fault", "INVESTIGATE", "backfill", "source"),
    "expected_event": Spec("source", "expected_event", "PASS_WITH_EXPLANATION", "backfill", "source"), "history_truncation": Spec("source", "fault", "INVESTIGATE", "truncation", "source"), "commodity_remap": Spec("source", "fault", "INVESTIGATE", "reclassification", "source"),
    "coding_error": Spec("coded", "fault", "INVESTIGATE", "coding", "coded"), "warehouse_transform_error": Spec("warehouse", "fault", "INVESTIGATE", "warehouse", "warehouse"), "recalculation": Spec("source", "fault", "INVESTIGATE", "historical_correction", "source"),
    "schema_failure": Spec("report", "fault", "DATA_CONTRACT_FAILURE", "schema_failure", "report"), "null_duplicate_storm": Spec("warehouse", "fault", "DATA_CONTRACT_FAILURE", "null_duplicate_storm", "warehouse"), "market_movement": Spec("warehouse", "movement", "INVESTIGATE", "market_movement", None),
    "entity_merge": Spec("source", "fault", "INVESTIGATE", "entity_merge", "source"), "week_restatement": Spec("source", "fault", "INVESTIGATE", "historical_correction", "source"), "clean": Spec("warehouse", "control", "PASS", "clean", None),
}


@dataclass
class Context:
    """Where a fault strikes: the last week, sorted ids, the seed and the size of the fault."""

    week: int
    stores: list[str]
    products: list[str]
    commodities: list[str]
    seed: int
    size: float | None = None

    def pick(self, ids: Sequence[str], n: int) -> list[str]:
        import random

        return sorted(random.Random(f"{self.seed}/{len(ids)}/{n}").sample(list(ids), max(1, min(n, len(ids)))))


@dataclass
class Case:
    family: str
    affected: dict[str, list[str]] = field(default_factory=dict)
    weeks: tuple[int, int] | None = None
    params: dict[str, Any] = field(default_factory=dict)
    registry: list[dict[str, Any]] = field(default_factory=list)


Fault = Callable[[DataFrame, Context], tuple[DataFrame, Case]]
INJECTORS: dict[str, Fault] = {}


def injector(family: str) -> Callable[[Fault], Fault]:
    def put(f: Fault) -> Fault:
        INJECTORS[family] = f
        return f

    return put


def _scaled(df: DataFrame, cond: Column, factor: Column | float, measures: Sequence[str] = ("dollar",)) -> DataFrame:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    whole = lambda m, x: F.round(x).cast("int") if m == "units" else F.round(x, 2)
    return df.withColumns({m: F.when(cond, whole(m, F.col(m) * factor)).otherwise(F.col(m)) for m in measures if m in df.columns})


def unused(ids: Sequence[str], first: int) -> str:
    """The first store id from a number on that the world doesn't have."""
    taken = set(ids)
    return next(i for n in range(first, first + len(taken) + 1) if (i := f"S{n:03d}") not in taken)


@injector("missing_stores")
def missing_stores(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    gone = c.pick(c.stores, round((c.size or 0.12) * len(c.stores)))
    return df.where(~((F.col("week") == c.week) & F.col("store_id").isin(gone))), Case("missing_stores", {"store": gone}, (c.week, c.week))


@injector("missing_products")
def missing_products(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    gone = c.pick(c.products, round((c.size or 0.1) * len(c.products)))
    return df.where(~((F.col("week") == c.week) & F.col("product_id").isin(gone))), Case("missing_products", {"product": gone}, (c.week, c.week))


@injector("new_store_backfill")
def new_store_backfill(df: DataFrame, c: Context, family: str = "new_store_backfill") -> tuple[DataFrame, Case]:
    model, new = c.pick(c.stores, 1)[0], unused(c.stores, 900)
    factor = c.size or 0.6 + 0.8 * ((c.seed * 7919) % 1000) / 1000
    clone = _scaled(df.where(F.col("store_id") == model), F.lit(True), factor, ("dollar", "units", "scripts", "stock")).withColumn("store_id", F.lit(new))
    case = Case(family, {"store": [new]}, (1, c.week), {"factor": factor, "model": model})
    if family == "expected_event":
        case.registry = [{"event_id": f"event-{c.seed}", "classification": NEW_BACKFILL, "entity_type": "store", "entity_ids": [new], "expected_history_start": 1, "expected_history_end": c.week, "confirmed": True, "approved_by": "generator", "approved_at": "2000-01-01T00:00:00+00:00"}]
    return df.unionByName(clone), case


@injector("expected_event")
def expected_event(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    return new_store_backfill(df, c, "expected_event")


@injector("history_truncation")
def history_truncation(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    cut, last = c.pick(c.stores, 1 + len(c.stores) // 12), max(2, round(c.week * (c.size or 0.3)))
    return df.where(~(F.col("store_id").isin(cut) & (F.col("week") <= last))), Case("history_truncation", {"store": cut}, (1, last))


@injector("commodity_remap")
def commodity_remap(dim: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    """Acts on the products dimension: stages after it follow."""
    a, b = c.pick(c.commodities, 2) if len(c.commodities) > 1 else (c.commodities[0], "C99")
    own = (F.col("commodity_id") == a) & (uniform(c.seed, "remap", "product_id") < (c.size or 0.5))
    return dim.withColumn("commodity_id", F.when(own, b).otherwise(F.col("commodity_id"))), Case("commodity_remap", {"commodity": [a, b]}, (1, c.week), {"from": a, "to": b})


@injector("coding_error")
def coding_error(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    hit, factor = c.pick(c.products, max(1, len(c.products) // 5)), 1 + (c.size or 0.25)
    return _scaled(df, F.col("product_id").isin(hit), factor), Case("coding_error", {"product": hit}, (1, c.week), {"factor": factor})


@injector("warehouse_transform_error")
def warehouse_transform_error(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    hit, factor = c.pick(c.commodities, 1), 1 - (c.size or 0.2)
    return _scaled(df, F.col("commodity_id").isin(hit), factor), Case("warehouse_transform_error", {"commodity": hit}, (1, c.week), {"factor": factor})


@injector("recalculation")
def recalculation(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    noise = F.exp((c.size or 0.05) * normal(c.seed, "recalculation", "store_id", "product_id", "week"))
    return _scaled(df, F.col("week") < c.week, noise), Case("recalculation", {}, (1, c.week - 1))


@injector("schema_failure")
def schema_failure(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    return df.drop("dollar"), Case("schema_failure", params={"column": "dollar"})


@injector("null_duplicate_storm")
def null_duplicate_storm(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    key = ("store_id", "product_id", "week")
    holed = df.withColumn("units", F.when(uniform(c.seed, "null", *key) < 0.05, None).otherwise(F.col("units")))
    return holed.unionByName(holed.where(uniform(c.seed, "twice", *key) < 0.03)), Case("null_duplicate_storm", {}, (1, c.week))


@injector("market_movement")
def market_movement(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    hit, factor = c.pick(c.commodities, 1), 1 - (c.size or 0.4)
    return _scaled(df, (F.col("week") == c.week) & F.col("commodity_id").isin(hit), factor, ("dollar", "units")), Case("market_movement", {"commodity": hit}, (c.week, c.week), {"factor": factor})


@injector("entity_merge")
def entity_merge(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    old, new = c.pick(c.stores, 1)[0], unused(c.stores, 800)
    own = F.col("store_id") == old
    merged = _scaled(df.where(own), F.lit(True), 0.9 + 0.2 * ((c.seed * 104729) % 1000) / 1000).withColumn("store_id", F.lit(new))
    return df.where(~own).unionByName(merged), Case("entity_merge", {"store": [old, new]}, (1, c.week))


@injector("week_restatement")
def week_restatement(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    at, factor = max(2, c.week // 2), 1 - (c.size or 0.1)
    return _scaled(df, F.col("week") == at, factor), Case("week_restatement", {}, (at, at), {"factor": factor})


@injector("clean")
def clean(df: DataFrame, c: Context) -> tuple[DataFrame, Case]:
    return df, Case("clean")


@dataclass
class Scenario:
    """Both versions in stages, their dimensions, the truth, and the clean current version to measure effects against."""

    family: str
    facts: dict[str, dict[str, DataFrame]]
    dims: dict[str, dict[str, DataFrame]]
    case: Case
    spec: Spec
    clean: dict[str, DataFrame]


def _stages(source: DataFrame, dims: Mapping[str, DataFrame], weeks: DataFrame, faults: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, DataFrame]:
    put = lambda s, df: (faults or {}).get(s, lambda x: x)(df)
    a = put("source", source)
    b = put("coded", coded(a, dims))
    c = put("warehouse", warehouse(b))
    return dict(zip(STAGES, (a, b, c, put("report", report(c, weeks))), strict=True))


def build(spark: SparkSession, family: str, profile: str = "small", seed: int = 7, size: float | None = None) -> Scenario:
    """One refresh of the world with one fault in its current version."""
    p, spec = PROFILES[profile], SPECS[family]
    dims, last = dimensions(spark, p.universe, seed, p.history.weeks), p.history.weeks
    weeks, source = week_table(spark, p.history), truth(spark, dims, p.universe, p.history, seed)
    ids = lambda n, c: [r[0] for r in dims[n].select(c).orderBy(c).collect()]
    context = Context(last, ids("stores", "store_id"), ids("products", "product_id"), ids("commodities", "commodity_id"), seed, size)
    before = with_late_arrivals(source.where(F.col("week") < last), p.history, last - 1, seed)
    plain = _stages(source, dims, weeks)
    now, case = dict(dims), Case(family)
    if family == "commodity_remap":
        now["products"], case = INJECTORS[family](dims["products"], context)
        current = _stages(source, now, weeks)
    else:
        said: list[Case] = []

        def strike(df: DataFrame) -> DataFrame:
            out, got = INJECTORS[family](df, context)
            said.append(got)
            return out

        if family in ("new_store_backfill", "expected_event", "entity_merge"):
            model = context.pick(context.stores, 1)[0]
            new = "S800" if family == "entity_merge" else "S900"
            now["stores"] = dims["stores"].unionByName(dims["stores"].where(F.col("store_id") == model).withColumn("store_id", F.lit(new)))
        current = _stages(source, now, weeks, {spec.stage: strike})
        case = said[0]
    return Scenario(family, {"V0001": _stages(before, dims, weeks), "V0002": current}, {"V0001": dims, "V0002": now}, case, spec, plain)


def effect(clean_frame: DataFrame, faulty: DataFrame, cond: Column | None = None) -> DataFrame:
    """Sums of the numeric columns on the affected rows, faulty less clean, in one pass over both."""
    names = [c for c in ("dollar", "units", "scripts", "stock") if c in clean_frame.columns and c in faulty.columns]
    side = lambda df, sign: (df if cond is None else df.where(cond)).select(*[F.col(n) * sign for n in names], F.lit(sign).alias("rows")).toDF(*names, "rows")
    return side(clean_frame, -1).unionByName(side(faulty, 1)).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in (*names, "rows")])


def relative_effect(clean_stages: Mapping[str, DataFrame], faulty: Mapping[str, DataFrame]) -> float:
    """Largest relative change of a week's value in any stage."""
    worst = 0.0
    for s, df in clean_stages.items():
        if "dollar" not in df.columns or "dollar" not in faulty[s].columns:
            continue
        tag = df.select("week", (-F.col("dollar")).alias("d"), F.col("dollar").alias("base")).unionByName(faulty[s].select("week", F.col("dollar").alias("d"), F.lit(0.0).alias("base")))
        got = tag.groupBy("week").agg(F.sum("d").alias("d"), F.sum("base").alias("b")).agg(F.max(F.abs("d") / F.greatest(F.abs("b"), F.lit(1e-9)))).first()[0]
        worst = max(worst, got or 0.0)
    return worst


def schedule(n: int, families: Sequence[str] | None = None) -> list[str]:
    """Families in turn, with a clean control after every fourth."""
    faults, out = list(families or [f for f in SPECS if f != "clean"]), []
    while len(out) < n:
        out.append("clean" if len(out) % 5 == 4 else faults[(len(out) - len(out) // 5) % len(faults)])
    return out


def verify(s: Scenario) -> dict[str, bool]:
    """Checks of the generator itself: the fault shows where it was put, and nowhere before."""
    at = STAGES.index(s.spec.stage) if s.family != "commodity_remap" else 1
    equal = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    out = {f"{st}_untouched": equal(s.clean[st], s.facts["V0002"][st]) for st in STAGES[:at]}
    stage = STAGES[at]
    now, then = s.facts["V0002"][stage], s.clean[stage]
    out[f"{stage}_{'same' if s.family == 'clean' else 'changed'}"] = (set(now.columns) == set(then.columns) and equal(now, then)) == (s.family == "clean")
    return out
