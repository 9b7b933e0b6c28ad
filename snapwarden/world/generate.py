"""Universe, weekly truth and pipeline stages. All draws are hashes of a seed and a row's keys, so that any partitioning gives the same rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapwarden.functions.calendars import easter

STAGES = ("source", "coded", "warehouse", "report")


@dataclass(frozen=True)
class Universe:
    banners: int = 4
    states: int = 3
    stores: int = 24
    products: int = 80
    commodities: int = 8
    script_share: float = 0.2
    assortment_share: float = 0.6

    def __post_init__(self) -> None:
        if min(self.banners, self.states, self.stores, self.products, self.commodities) < 1 or self.commodities > self.products:
            raise ValueError("counts must be at least 1, and commodities at most as many as products")
        if not 0 <= self.script_share <= 1 or not 0 < self.assortment_share <= 1:
            raise ValueError("shares must be inside [0, 1]")


@dataclass(frozen=True)
class History:
    weeks: int = 104
    start: str = "2022-01-01"
    trend: float = 0.04
    noise: float = 0.08
    promo_share: float = 0.05
    promo_lift: float = 1.6
    christmas: float = 1.35
    easter: float = 1.15
    year_end: float = 1.12
    base_units: float = 20.0
    cover: float = 5.0
    commodity_season: float = 0.0
    market_shock: float = 0.0
    commodity_shock: float = 0.0
    intermittency: float = 0.0
    late_weeks: int = 0
    late_share: float = 0.0

    def __post_init__(self) -> None:
        if self.weeks < 4 or self.noise < 0 or not 0 <= self.late_share < 0.5 or not 0 <= self.commodity_season < 1 or not 0 <= self.intermittency <= 1:
            raise ValueError("history settings out of range")


@dataclass(frozen=True)
class Profile:
    universe: Universe = field(default_factory=Universe)
    history: History = field(default_factory=History)


PROFILES = {
    "tiny": Profile(Universe(2, 2, 4, 24, 3), History(30, "2024-01-06")),
    "small": Profile(),
    "realistic": Profile(history=History(commodity_season=0.35, market_shock=0.04, commodity_shock=0.03, intermittency=0.3, late_weeks=2, late_share=0.03)),
    "full": Profile(Universe(8, 5, 60, 300, 15), History(320, "2020-07-04")),
}


def uniform(seed: int, name: str, *keys: Column | str) -> Column:
    """A number in (0, 1) from a hash."""
    h = F.xxhash64(F.lit(seed), F.lit(name), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, name: str, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, name + "/r", *keys))) * F.cos(2 * math.pi * uniform(seed, name + "/a", *keys))


def lognormal(seed: int, name: str, sigma: float, *keys: Column | str) -> Column:
    return F.exp(sigma * normal(seed, name, *keys))


def dimensions(spark: SparkSession, u: Universe, seed: int, horizon: int) -> dict[str, DataFrame]:
    """States, banners, stores, commodities and products: driver-sized."""
    rng = np.random.Generator(np.random.PCG64(seed))
    states = [(f"ST{i + 1}", f"State {i + 1}") for i in range(u.states)]
    banners = [(f"B{i + 1}", f"Banner {i + 1}", states[i % u.states][0]) for i in range(u.banners)]
    stores = [(f"S{i + 1:03d}", f"Store {i + 1}", banners[i % u.banners][0], states[int(rng.integers(u.states))][0], 1) for i in range(u.stores)]
    commodities = [(f"C{i + 1:02d}", f"Category {i + 1}") for i in range(u.commodities)]
    products = [(f"P{i + 1:04d}", f"Product {i + 1}", commodities[i % u.commodities][0], bool(rng.random() < u.script_share), float(rng.lognormal(0, 0.6))) for i in range(u.products)]
    make = spark.createDataFrame
    return {
        "states": make(states, "state_id string, state_name string"), "banners": make(banners, "banner_id string, banner_name string, home_state string"), "stores": make(stores, "store_id string, store_name string, banner_id string, state_id string, open_week int"),
        "commodities": make(commodities, "commodity_id string, commodity_name string"), "products": make(products, "product_id string, product_name string, commodity_id string, is_script boolean, base_popularity double"),
    }


def week_table(spark: SparkSession, h: History) -> DataFrame:
    """(week, week_end, factor): trend, season and holidays; one row per week."""
    first = date.fromisoformat(h.start)
    ends = [first + timedelta(weeks=k) for k in range(h.weeks)]
    rows = []
    for k, day in enumerate(ends):
        year_week = day.isocalendar()[1]
        factor = (1 + 0.05 * math.sin(2 * math.pi * year_week / 52.18) + 0.02 * math.cos(4 * math.pi * year_week / 52.18)) * (1 + h.trend) ** (k / 52)
        boosts = [b for y in (day.year, day.year - 1) for when, b in ((date(y, 12, 25), h.christmas), (date(y, 6, 30), h.year_end), (easter(y), h.easter)) if timedelta(0) <= day - when < timedelta(days=7)]
        rows.append((k + 1, day, factor * max([1.0, *boosts]), year_week))
    return spark.createDataFrame(rows, "week int, week_end date, factor double, year_week int")


def truth(spark: SparkSession, dims: dict[str, DataFrame], u: Universe, h: History, seed: int) -> DataFrame:
    """The source stage of all weeks: (week, store_id, product_id, units, dollar, scripts, stock)."""
    pairs = dims["stores"].select("store_id", "open_week").crossJoin(dims["products"].select("product_id", "commodity_id", "is_script", "base_popularity")).where(uniform(seed, "assortment", "store_id", "product_id") < u.assortment_share)
    cells = pairs.crossJoin(F.broadcast(week_table(spark, h))).where("week >= open_week")
    factor = F.col("factor")
    if h.commodity_season:
        wave = F.sin(2 * math.pi * (F.col("year_week") - 52.18 * uniform(seed, "phase", "commodity_id")) / 52.18)
        factor = factor * (1 + h.commodity_season * uniform(seed, "amplitude", "commodity_id") * wave)
    if h.market_shock:
        factor = factor * lognormal(seed, "market", h.market_shock, "week")
    if h.commodity_shock:
        factor = factor * lognormal(seed, "category", h.commodity_shock, "commodity_id", "week")
    if h.intermittency:
        trades = F.when(uniform(seed, "slow", "product_id") < h.intermittency, 0.25 + 0.5 * uniform(seed, "trades", "product_id")).otherwise(1.0)
        cells = cells.where(uniform(seed, "trade", "store_id", "product_id", "week") < trades)
    key = ("store_id", "product_id", "week")
    promo = F.when(uniform(seed, "promo", *key) < h.promo_share, 1.3 + (h.promo_lift - 1.3) * uniform(seed, "lift", *key)).otherwise(1.0)
    units = F.round(h.base_units * F.col("base_popularity") * lognormal(seed, "store", 0.3, "store_id") * factor * promo * lognormal(seed, "noise", h.noise, *key)).cast("int")
    price = F.when(F.col("is_script"), 45.0).otherwise(12.0) * lognormal(seed, "price", 0.35, "product_id") * lognormal(seed, "till", 0.03, *key)
    out = cells.select("week", "store_id", "product_id", "is_script", units.alias("units"), price.alias("price"))
    return out.select("week", "store_id", "product_id", "units", F.round(F.col("units") * F.col("price"), 2).alias("dollar"), F.when(F.col("is_script"), F.col("units")).otherwise(0).cast("double").alias("scripts"), (F.col("units") * h.cover * lognormal(seed, "stock", 0.15, *key)).alias("stock"))


def coded(source: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    out = source.join(F.broadcast(dims["products"].select("product_id", "commodity_id")), "product_id", "left").join(F.broadcast(dims["stores"].select("store_id", "banner_id", "state_id")), "store_id", "left")
    return out.select(*source.columns, "commodity_id", "banner_id", "state_id")


def warehouse(frame: DataFrame) -> DataFrame:
    return frame.withColumn("dollar_per_unit", F.try_divide(F.col("dollar"), F.col("units")))


def report(frame: DataFrame, weeks: DataFrame) -> DataFrame:
    sums = [F.sum(m).alias(m) for m in ("dollar", "units", "scripts", "stock") if m in frame.columns]
    out = frame.groupBy("week", "banner_id", "state_id").agg(*sums, F.count_distinct("store_id").alias("store_count"), F.count_distinct("product_id").alias("product_count"))
    return out.join(F.broadcast(weeks.select("week", "week_end")), "week", "left")


def with_late_arrivals(previous: DataFrame, h: History, last: int, seed: int) -> DataFrame:
    """The previous snapshot counts its latest weeks short."""
    out = previous
    for lag in range(h.late_weeks):
        keep = 1 - h.late_share * 2 * uniform(seed, f"late{lag}", "store_id", "product_id") / (lag + 1)
        hit = F.col("week") == last - lag
        out = out.withColumns({"units": F.when(hit, F.round(F.col("units") * keep).cast("int")).otherwise(F.col("units")), "dollar": F.when(hit, F.round(F.col("dollar") * keep, 2)).otherwise(F.col("dollar"))})
    return out


def smaller(profile: Profile, **history: float) -> Profile:
    return replace(profile, history=replace(profile.history, **history))
