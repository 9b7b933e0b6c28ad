"""One query for each operator over the derived weekly fact, with production settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapwarden.evaluate import feeds, scores
from snapwarden.functions import aggregates
from snapwarden.operators import attribution, checks, contracts, cubes, fingerprints, lifecycle, pairs, relationships
from snapwarden.plans import approvals, series
from snapwarden.sources import versions as feeds_in
from snapwarden.sources.derived import CONFIG, table, versions, written_fact
from snapwarden.world import faults

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

M6, R8 = 6, 8


def query(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
    """Register a query of the two versions."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*versions(spark, sf_dir))

    QUERIES[f.__name__] = run
    return run


def raw_query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def pair_of(previous: DataFrame, current: DataFrame) -> pairs.VersionPair:
    return pairs.build_pair(previous, current, CONFIG)


def _cube(df: DataFrame, previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return rounded(df, **{f"{m}_{x}": 6 for m in ("dollar", "units") for x in ("previous", "current", "delta")}, **{f"{m}_relative": R8 for m in ("dollar", "units")})


# --- cubes
@query
def r1_revision_cube_base(previous, current):
    return _cube(cubes.revision_cube(previous, current, CONFIG.base_keys, CONFIG, [357]), previous, current, CONFIG.base_keys)


@query
def r1_revision_cube_week(previous, current):
    return _cube(cubes.revision_cube(previous, current, ["week"], CONFIG, [357]), previous, current, ["week"])


@query
def r2_revision_cube_headline(previous, current):
    return _cube(cubes.revision_cube(previous, current, CONFIG.headline_keys, CONFIG, [357]), previous, current, CONFIG.headline_keys)


@query
def r3_cube_summary(previous, current):
    return rounded(cubes.cube_summary(cubes.revision_cube(previous, current, CONFIG.base_keys, CONFIG, [357]), "dollar"), previous=2, current=2, delta=2)


@raw_query
def a1_aggregate(spark, sf_dir):
    counted = written_fact(spark, sf_dir).withColumns({"store_count": F.lit(0), "product_count": F.lit(0)})
    return rounded(cubes.aggregate(counted, ["week", "banner_id", "state_id"], CONFIG), dollar=6)


@query
def a3_hierarchy_levels(previous, current):
    cells = checks.hierarchy(current, CONFIG)
    columns = ["store_id", "product_id", "commodity_id", "banner_id", "state_id"]
    return rounded(cells.select("level", "week", *columns, "dollar", "units", "store_count", "product_count"), dollar=6)


@query
def a6_presence(previous, current):
    return rounded(lifecycle.presence(current, lifecycle.shared_entities(previous, current, CONFIG), CONFIG), value=6)


@query
def a8_overlap_totals(previous, current):
    got = cubes.overlap_totals(cubes.revision_cube(previous, current, CONFIG.base_keys, CONFIG, [357]), CONFIG)
    return rounded(got.select("raw_delta", "previous_total", "gross_delta", "breadth", "rows", F.col("per_units").alias("units_delta")), raw_delta=2, previous_total=2, gross_delta=2, breadth=R8)


@query
def a11_top_contributors(previous, current):
    return rounded(cubes.contributors(cubes.revision_cube(previous, current, CONFIG.base_keys, CONFIG, [357]), "store_id", CONFIG), delta=6, abs_delta=6)


@query
def a15_fingerprint(previous, current):
    return rounded(fingerprints.fingerprint(current, CONFIG), sum_dollar=2)


@query
def a16_entity_set_hash(previous, current):
    side = lambda df, n: fingerprints.entity_set_hash(df, ["store_id", "product_id"]).withColumn("version", F.lit(n))
    return side(previous, "previous").unionByName(side(current, "current"))


@raw_query
def a14_duplicate_fraction_raw_grain(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) / 7).cast("int") + 1).alias("week"), "l_suppkey", "l_partkey")
    return rounded(contracts.duplicate_fraction(lines, ["week", "l_suppkey", "l_partkey"]), duplicate_fraction=12)


@query
def a13_null_fraction(previous, current):
    holed = current.withColumn("units", F.when(F.col("product_id").endswith("9"), None).otherwise(F.col("units")))
    return rounded(contracts.null_fraction(holed, ["dollar", "units"]), null_fraction=10)


@query
def a27_correlation_of_banner_and_total(previous, current):
    s = series.long_series(current, CONFIG, ["dollar"])
    total = s.where("series_id = 'national'").select("week", F.col("value").alias("total"))
    return rounded(aggregates.correlation(s.where("series_id like 'banner_id:%'").join(total, "week"), ["series_id"], "value", "total"), correlation=6)


# --- contracts and pairs
@query
def c_contract_facts(previous, current):
    dirty = current.unionByName(current.where("week = 10 and store_id = '3'")).withColumn("units", F.when(F.col("product_id").endswith("77"), None).otherwise(F.col("units"))).withColumn("store_id", F.when(F.col("product_id").endswith("55"), None).otherwise(F.col("store_id"))).where("week <> 100")
    got = contracts.facts(dirty, CONFIG.base_keys, ["dollar", "units"], "week")
    return got.select("rows", "key_nulls", "duplicates", "nulls", "unfinite", "week_nulls", "first_week", "last_week", "weeks", "whole_weeks")


@query
def c_contract_checks(previous, current):
    found = contracts.validate(current.where("week <> 100"), previous, CONFIG)
    return current.sparkSession.createDataFrame([(c.name, c.passed) for c in found], "name string, passed boolean")


@query
def v2_version_pair(previous, current):
    p = pair_of(previous, current)
    return current.sparkSession.createDataFrame([(p.previous_min_week, p.previous_max_week, p.current_min_week, p.current_max_week, p.overlap_start, p.overlap_end, len(p.new_periods), p.shape)], "previous_min_week int, previous_max_week int, current_min_week int, current_max_week int, overlap_start int, overlap_end int, new_weeks int, shape string")


# --- lifecycle
@query
def l1_entity_changes(previous, current):
    e = lifecycle.entity_changes(previous, current, pair_of(previous, current), CONFIG)
    shown = e.select("entity_type", "entity_id", "classification", F.array_join("classifications", ",").alias("classes"), "first_week_previous", "last_week_previous", "first_week_current", "last_week_current", "week_count_previous", "week_count_current", "rows_previous", "rows_current", F.size("historical_weeks_added").alias("n_added"), F.size("historical_weeks_removed").alias("n_removed"), "historical_value_added", "historical_value_removed", "expected_value", "expected_period_total")
    return rounded(shown, historical_value_added=6, historical_value_removed=6, expected_value=6, expected_period_total=6)


@query
def l3_absence_baseline(previous, current):
    return rounded(lifecycle.absence_baseline(previous, CONFIG), share=R8)


@query
def l4_missing_entity_impact(previous, current):
    e = lifecycle.entity_changes(previous, current, pair_of(previous, current), CONFIG)
    got = lifecycle.missing_impact(e, CONFIG, lifecycle.absence_baseline(previous, CONFIG))
    return rounded(got, expected_lost=6, expected_period_total=6, share=R8, threshold=6, baseline_max=R8)


@query
def l5_reclassification(previous, current):
    got = lifecycle.reclassifications(previous, current, pair_of(previous, current), CONFIG)
    got = got.withColumn("products", F.array_join("products", ","))
    return rounded(got, moved_previous=2, moved_current=2, from_delta=2, to_delta=2, gross_moved=2, conservation_ratio=R8)


@query
def l6_replacements(previous, current):
    got = relationships.replacements(previous, current, pair_of(previous, current), CONFIG, kept=[])
    return rounded(got, correlation=6, ratio=6, p_value=6, adjusted_p=6)


# --- attribution
def _registry(current) -> DataFrame:
    entries = [
        {"event_id": "close-7", "dataset": CONFIG.name, "approved_by": "a", "confirmed": True, "classification": lifecycle.LATEST_MISSING, "entity_type": "store", "entity_ids": ["7"], "effective_from_week": 350, "effective_to_week": 400},
        {"event_id": "cut-11", "dataset": CONFIG.name, "approved_by": "a", "confirmed": True, "classification": lifecycle.TRUNCATED, "entity_type": "store", "entity_ids": ["11", "61"], "expected_history_start": 1, "expected_history_end": 20},
        {"event_id": "back-17", "dataset": CONFIG.name, "approved_by": "a", "confirmed": True, "event_type": "new_entity_historical_backfill", "entity_type": "store", "entity_ids": ["17"], "expected_history_start": 1, "expected_history_end": 357},
        {"event_id": "not-approved", "dataset": CONFIG.name, "classification": lifecycle.REMOVED, "entity_type": "store", "entity_ids": ["13"], "expected_history_start": 1, "expected_history_end": 357},
    ]
    return attribution.registry_frame(current.sparkSession, entries, CONFIG)


@query
def at3_registry_match(previous, current):
    p = pair_of(previous, current)
    e = lifecycle.entity_changes(previous, current, p, CONFIG)
    got = attribution.match_approvals(e, _registry(current), CONFIG, p.current_max_week)
    return got.select("entity_type", "entity_id", "classification", "approval", "absence_approval")


@query
def at2_week_revisions(previous, current):
    cube = cubes.revision_cube(previous, current, CONFIG.base_keys, CONFIG, [357])
    e = lifecycle.entity_changes(previous, current, pair_of(previous, current), CONFIG)
    got = attribution.week_revisions(cube, e, CONFIG, "store")
    return rounded(got, previous=6, delta=6, explained=6, unexplained=6, relative=R8)


@query
def at8_standing_closures(previous, current):
    return attribution.standing_closures(current, _registry(current), 357, CONFIG)


@query
def at10_like_for_like(previous, current):
    closures = current.sparkSession.createDataFrame([("store", "7"), ("store", "57")], "entity_type string, entity_id string")
    moves = lifecycle.reclassifications(previous, current, pair_of(previous, current), CONFIG).select(F.explode("products").alias("product_id"), "from_commodity", "to_commodity")
    p, c = attribution.like_for_like(previous, current, closures, moves)
    tag = lambda df, n: df.groupBy("commodity_id").agg(F.sum("dollar").alias("dollar"), F.count(F.lit(1)).alias("rows")).withColumn("version", F.lit(n))
    return rounded(tag(p, "previous").unionByName(tag(c, "current")), dollar=2)


@query
def at1_explain_revision(previous, current):
    p = pair_of(previous, current)
    e = lifecycle.all_events(previous, current, p, CONFIG).persist()
    m = attribution.match_approvals(e, _registry(current), CONFIG, p.current_max_week).persist()
    try:
        a = attribution.explain(cubes.revision_cube(previous, current, CONFIG.base_keys, CONFIG, [357]), m, CONFIG, attribution.explanation_type(e, CONFIG))
    finally:
        m.unpersist()
        e.unpersist()
    names = ("raw_delta", "gross_delta", "explained_added", "explained_removed", "unexplained_delta")
    row = (*[round(a[n], 2) for n in names], round(a["explained_fraction"], 8), a["material"], a["structural"], a["unmatched"], a["explanation_type"])
    kinds = ", ".join(f"{n} double" for n in names) + ", explained_fraction double, material boolean, structural long, unmatched long, explanation_type string"
    return current.sparkSession.createDataFrame([row], kinds)


# --- checks
@query
def cf1_counterfactual(previous, current):
    e = lifecycle.entity_changes(previous, current, pair_of(previous, current), CONFIG)
    got = checks.counterfactual(previous, current, e, CONFIG)
    return rounded(got, raw_delta=2, explained_delta=2, reconstructed_delta=2, absolute_residual=2, previous_total=2, score=R8)


@query
def cf2_entity_week_sums(previous, current):
    return rounded(checks.entity_week_sums(current, "store_id", CONFIG), value=6)


def _report(current):
    """A report whose week 300 lost a banner's value, and whose store counts of week 200 are off."""
    out = checks.build_report(current.withColumn("store_count", F.lit(0)), CONFIG)
    return out.withColumns({"dollar": F.when((F.col("week") == 300) & (F.col("banner_id") == "3"), F.col("dollar") * 0.5).otherwise(F.col("dollar")), "store_count": F.when(F.col("week") == 200, F.col("store_count") + 1).otherwise(F.col("store_count"))})


@query
def rc1_mass_balance(previous, current):
    got = checks.mass_balance(current, _report(current), CONFIG)
    passed = F.col("worst") <= CONFIG.reconciliation_tolerance
    return rounded(got.select("measure", "keys", "worst", passed.alias("passed"), F.when(~passed, F.col("worst_key.week")).alias("week"), "covered"), worst=6)


@query
def rc2_count_consistency(previous, current):
    return checks.count_mismatches(current, _report(current), "store_count", "store_id", CONFIG)


@query
def rc3_marker_rows(previous, current):
    marked = current.withColumn("commodity_id", F.when(F.col("product_id").endswith("00"), "Total").otherwise(F.col("commodity_id")))
    return checks.marker_rows(marked, CONFIG)


@query
def rc4_price_outliers(previous, current):
    odd = current.withColumn("dollar", F.when(F.col("week").isin(356, 357), F.col("dollar") * 2).otherwise(F.col("dollar")))
    return rounded(checks.price_outliers(odd, CONFIG, [356, 357]), ratio=6, median=6, robust_z=6)


@query
def a24_unit_value_by_week(previous, current):
    return rounded(checks.unit_values(current, CONFIG), ratio=6)


@query
def a25_median_and_mad(previous, current):
    weekly = series.long_series(current, CONFIG, ["dollar", "units"])
    return rounded(aggregates.median_and_mad(weekly, ["metric", "series_id"], "value"), median=6, mad=6)


@query
def a26_quantiles(previous, current):
    weekly = series.long_series(current, CONFIG, ["dollar", "units"])
    return rounded(aggregates.quantiles(weekly, "value", CONFIG.forecast_quantiles, ["metric", "series_id"]), **{f"q{k:02d}": 6 for k in (1, 5, 25, 50, 75, 95, 99)})


@query
def h1_hierarchy_deviations(previous, current):
    lost = current.withColumn("state_id", F.when(F.col("product_id").endswith("13"), None).otherwise(F.col("state_id")))
    return rounded(checks.hierarchy_deviations(lost, CONFIG), worst=6)


@query
def h2_national_shares(previous, current):
    return rounded(checks.national_shares(current, ["banner_id", "commodity_id"], CONFIG, 356), share=R8)


def _stages(previous, current):
    """A source, and a warehouse that adds a fault of its own to some products."""
    plain = lambda df: df.select("week", "store_id", "product_id", "units", "dollar")
    bent = current.withColumn("dollar", F.col("dollar") * F.when(F.col("product_id").endswith("42") & (F.col("week") <= 356), 1.25).otherwise(1.0))
    return [("source", plain(previous), plain(current)), ("warehouse", previous, bent)]


@query
def ln1_stage_increments(previous, current):
    got = checks.stage_increments(_stages(previous, current), F.col("week").between(1, 356), CONFIG)
    return rounded(got, increment=R8)


@query
def ln2_divergence(previous, current):
    return rounded(checks.divergence(previous, current, CONFIG.base_keys, F.col("week").between(1, 356), CONFIG), relative_divergence=R8)


@query
def ln3_week_revision(previous, current):
    return rounded(checks.week_revision(previous, current, F.col("week").between(1, 356), CONFIG), revision=6, scale=6)


@query
def rf1_reference(previous, current):
    control = current.groupBy("week", "banner_id").agg((F.sum("dollar") * F.when(F.col("week") == 77, 1.02).otherwise(1.0)).alias("dollar"), F.sum("units").alias("units"))
    got = checks.reference_cells(current, control, ["week", "banner_id"], ["dollar", "units"])
    return rounded(got, current_total=2, reference_total=2, relative_delta=6)


# --- latest period
@query
def t1_dense_series(previous, current):
    return rounded(series.dense_series(current, CONFIG, ["dollar", "units"]), value=6)


@query
def t2_seasonal_difference_scale(previous, current):
    return rounded(series.difference_scales(previous, CONFIG, ["dollar", "units"]), scale=4)


@query
def t3_forecast_quantiles(previous, current):
    return rounded(series.forecasts(previous, CONFIG, ["dollar", "units"]), value=4)


def _evidence(previous, current) -> DataFrame:
    p = pair_of(previous, current)
    return series.evidence(previous, current, p, lifecycle.entity_changes(previous, current, p, CONFIG), CONFIG, ["dollar", "units"])


@query
def t4_point_and_residual(previous, current):
    got = _evidence(previous, current).where("support = 'model'")
    return rounded(got.select("metric", "series_id", "target", "actual", "adjustment", "point", "scale", "standardized"), actual=4, adjustment=4, point=4, scale=4, standardized=6)


@query
def t5_robust_z(previous, current):
    return rounded(_evidence(previous, current).where("support = 'model'").select("metric", "series_id", "robust_z"), robust_z=6)


@query
def t6_seasonal_z(previous, current):
    return rounded(_evidence(previous, current).where("support = 'model'").select("metric", "series_id", "seasonal_z"), seasonal_z=6)


@query
def t7_ewma_z(previous, current):
    return rounded(_evidence(previous, current).where("support = 'model'").select("metric", "series_id", "ewma_z"), ewma_z=6)


@query
def t8_change_point(previous, current):
    return rounded(_evidence(previous, current).where("support = 'model'").select("metric", "series_id", "change_point"), change_point=6)


@query
def t24_share_test(previous, current):
    got = _evidence(previous, current).where("share_method is not null")
    shown = got.select("metric", "series_id", "share_method", "share_n", "share_t", "share_spread", "share_level", "share_impact")
    return rounded(shown, share_t=5, share_spread=8, share_level=8, share_impact=2)


@query
def j20_share_of_parent(previous, current):
    return rounded(series.share_history(previous, CONFIG, ["dollar", "units"]).select("metric", "series_id", "week", "share"), share=10)


@query
def j21_year_ago_share(previous, current):
    got = series.share_history(previous, CONFIG, ["dollar", "units"]).where("year_ago is not null and share > 0")
    return rounded(got.select("metric", "series_id", "week", F.log(F.col("share") / F.col("year_ago")).alias("change")), change=R8)


@query
def t29_benjamini_hochberg(previous, current):
    number = F.expr("try_cast(store_id as int)")
    weekly = current.groupBy("store_id").agg((F.pmod(F.sum("units").cast("long") * 7919, F.lit(1000)) / 1000.0 * F.when(number % 7 == 0, 0.001).otherwise(1.0)).alias("p_value"))
    return rounded(relationships.benjamini_hochberg(weekly, 0.05), p_value=10, adjusted_p=10)


@query
def t32_new_entity_adjustments(previous, current):
    e = lifecycle.entity_changes(previous, current, pair_of(previous, current), CONFIG)
    rows = series.new_entity_rows(current, e, CONFIG, [357])
    return rounded(series.long_series(rows, CONFIG, ["dollar", "units"]), value=6)


@query
def t33_series_reasons(previous, current):
    return _evidence(previous, current).select("metric", "series_id", "target", "reason", "required", "support", "history_observed")


@query
def t34_latest_decision(previous, current):
    p = pair_of(previous, current)
    e = lifecycle.entity_changes(previous, current, p, CONFIG)
    got = series.assess_latest(previous, current, p, e, CONFIG, ["dollar", "units"])
    return got.select("metric", "series_id", "target", "reason", "p_value", "adjusted_p", "significant", "anomaly", "decided_by", "calibration_status", "interval_lower", "interval_upper", F.array_join("flags", ",").alias("flags"))


# --- filters, joins, sets
@query
def p4_without_entities(previous, current):
    gone = current.sparkSession.createDataFrame([("store", "7"), ("commodity", "PROMO")], "entity_type string, entity_id string")
    return rounded(attribution.without_entities(current, gone).groupBy("week").agg(F.count(F.lit(1)).alias("rows"), F.sum("dollar").alias("dollar")), dollar=6)


@query
def u4_weeks_gained_and_lost(previous, current):
    e = lifecycle.entity_changes(previous, current, pair_of(previous, current), CONFIG)
    rows = lambda c, how: e.select("entity_type", "entity_id", F.explode(c).alias("week"), F.lit(how).alias("how"))
    return rows("historical_weeks_added", "added").unionByName(rows("historical_weeks_removed", "removed"))


@query
def u5_one_sided_entities(previous, current):
    p, columns = pair_of(previous, current), list(CONFIG.entity_columns)
    got = relationships.one_sided(previous, current, columns, p, CONFIG)
    return rounded(got.withColumn("side", F.when(F.col("new"), F.lit("current")).otherwise(F.lit("previous"))).drop("new"), v=6)


@query
def k7_worst_key(previous, current):
    got = checks.mass_balance(current, _report(current), CONFIG).where("measure = 'dollar'")
    return rounded(got.select("worst_key.week", "worst_key.banner_id", "worst_key.state_id", "worst"), worst=6)


@raw_query
def s14_epoch_weeks(spark, sf_dir):
    from snapwarden.functions.calendars import epoch_week

    return table(spark, sf_dir, "orders").groupBy(epoch_week(F.col("o_orderdate")).alias("epoch_week")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@raw_query
def s17_wide_feed_to_weekly(spark, sf_dir):
    """The events as a feed with one column per day, read back by week, user and type."""
    ev = table(spark, sf_dir, "events")
    days = [str(r[0]) for r in ev.select(F.col("ts").cast("date")).distinct().orderBy("ts").collect()]
    wide = ev.groupBy("user_id", "event_type").agg(*[F.coalesce(F.sum(F.when(F.col("ts").cast("date") == F.lit(d).cast("date"), F.col("value"))), F.lit(0.0)).alias(d) for d in days])
    calendar = spark.createDataFrame([(d,) for d in days], "day string").withColumn("week", F.floor(F.datediff(F.col("day").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("int"))
    return rounded(feeds_in.weekly_long(wide, days, ["user_id", "event_type"], calendar, "value"), value=6)


@raw_query
def s18_daily_sales_to_weekly(spark, sf_dir):
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_type").alias("commodity_id"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("state_id"))
    stores = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("store"), "state_id")
    return feeds_in.weekly_sales(table(spark, sf_dir, "lineitem"), products, stores, "1995-01-02", day="l_shipdate", store="l_suppkey", product="l_partkey", value="l_quantity")


@query
def x7_real_absences(previous, current):
    return feeds.real_absences(current, 357, list(CONFIG.entity_columns), CONFIG)


@query
def x8_share_rules(previous, current):
    p = lambda a, b: F.pmod(F.sum("units").cast("long") * a, F.lit(b)) / float(b)
    tests = current.groupBy("week", F.col("store_id").alias("series_id")).agg((p(7919, 1009) * 0.05).alias("trailing_p"), F.when(F.sum("units") % 5 > 0, p(104729, 997)).alias("seasonal_p"))
    tests = tests.withColumns({"p": F.least("trailing_p", F.coalesce("seasonal_p", F.lit(1.0))), "planted": F.col("series_id").endswith("7")})
    return feeds.score_share_rule(feeds.add_share_rules(tests), "bonferroni", 0.05)


@query
def a32_sweep_summary(previous, current):
    own = current.groupBy("store_id").agg(F.first("banner_id").alias("family"), F.first("state_id").cast("double").alias("magnitude"), (F.sum("units").cast("long") % 3 == 0).alias("flagged"), F.round(F.sum("dollar"), 2).alias("effect"))
    return scores.sweep_summary(own)


@query
def a33_case_metrics(previous, current):
    n = F.sum("units").cast("long")
    own = current.groupBy("store_id").agg(F.first("banner_id").alias("family"), (n % 3 == 0).alias("flagged"), (n % 2 == 0).alias("actionable"), (n % 13).cast("double").alias("latency_weeks"))
    return scores.metrics_frame(own, ["family"])


@query
def a21_effect_delta(previous, current):
    return rounded(faults.effect(previous, current, (F.col("product_id").cast("int") % 97 == 3) & (F.col("week") <= 340)), dollar=2)


@query
def a23_split_effects(previous, current):
    return rounded(attribution.split_effects(previous, current, "commodity_id", ["dollar", "units"]), dollar=2)


@query
def ex1_expectations(previous, current):
    """The price flags of two odd weeks against three expectations: one that covers a week, one too narrow, one not approved."""
    odd = current.withColumn("dollar", F.when(F.col("week").isin(356, 357), F.col("dollar") * 2).otherwise(F.col("dollar")))
    flags = checks.price_outliers(odd, CONFIG, [356, 357]).select((F.col("week") - 356).alias("number"), F.lit("dollar_per_unit").alias("flag_metric"), F.col("week").alias("flag_week"), F.col("ratio").alias("flag_ratio"))
    band = {"dataset": CONFIG.name, "metric": "dollar_per_unit"}
    given = [approvals.RatioExpectation("wide", **band, min_ratio=0.0, week=356, approved_by="a"), approvals.RatioExpectation("narrow", **band, max_ratio=1.0, approved_by="a"), approvals.RatioExpectation("open", **band, min_ratio=0.0)]
    got = approvals.match_expectations(flags, approvals.expectation_table(current.sparkSession, given, None), CONFIG.name)
    return got.select((F.col("number") + 356).alias("week"), F.array_join("covered.expectation_id", ",").alias("covered"), F.array_join("refused.reason", ",").alias("refused"))


@query
def g5_report_stage(previous, current):
    return rounded(checks.build_report(current, CONFIG), dollar=6)
