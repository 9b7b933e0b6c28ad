"""Entity lifecycles between two versions, absence baselines, and moves of products between categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig
from snapwarden.operators.pairs import VersionPair

NEW_BACKFILL, NEW_RECENT, REMOVED = "NEW_ENTITY_HISTORICAL_BACKFILL", "NEW_ENTITY_RECENT", "ENTITY_REMOVED"
TRUNCATED, EXTENDED, LATEST_MISSING, RECLASSIFIED = "ENTITY_HISTORY_TRUNCATED", "ENTITY_HISTORY_EXTENDED", "LATEST_WEEK_MISSING", "POSSIBLE_RECLASSIFICATION"
#: Classes that change history and so can explain a revision.
EXPLAINABLE = (NEW_BACKFILL, NEW_RECENT, TRUNCATED, EXTENDED, REMOVED, RECLASSIFIED)
#: Fewer recent weeks than this and an absence baseline isn't used.
MIN_BASELINE = 13


def entity_type(column: str) -> str:
    return column.removesuffix("_id")


def _entities(columns: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(entity_type(c)).alias("entity_type"), F.col(c).cast("string").alias("entity_id")) for c in columns]))


def presence(df: DataFrame, columns: Sequence[str], config: DatasetConfig) -> DataFrame:
    """(entity_type, entity_id, week, value, rows). value is null where no row has one: that is no presence."""
    week, metric = F.col(config.week_column), F.col(config.primary_metric)
    return df.select(_entities(columns).alias("e"), week.alias("week"), metric.alias("m")).groupBy("e.entity_type", "e.entity_id", "week").agg(F.sum("m").alias("value"), F.count(F.lit(1)).alias("rows"))


def shared_entities(previous: DataFrame, current: DataFrame, config: DatasetConfig) -> list[str]:
    return [c for c in config.entity_columns if c in previous.columns and c in current.columns]


def presence_window(pair: VersionPair, config: DatasetConfig) -> tuple[int, int]:
    return max(pair.overlap_start, pair.previous_max_week - config.entity_presence_window + 1), pair.previous_max_week


def entity_changes(previous: DataFrame, current: DataFrame, pair: VersionPair, config: DatasetConfig) -> DataFrame:
    """One row per changed entity: classes in order, its weeks on both sides, and the value that history gained and lost.

    Both versions are tagged, united and grouped by entity and week in one shuffle; a second grouping by entity makes the
    event. Weeks of one entity are as many as periods, so the collected lists are bounded by the calendar.
    """
    columns, metric = shared_entities(previous, current, config), config.primary_metric
    first, last = presence_window(pair, config)
    span = max(0, last - first + 1)
    side = lambda df, new: df.select(_entities(columns).alias("e"), F.col(config.week_column).alias("week"), F.col(metric).alias("m"), F.lit(new).alias("new"))
    both = side(previous, False).unionByName(side(current, True))
    weekly = both.groupBy("e.entity_type", "e.entity_id", "week").agg(
        F.sum(F.when(~F.col("new"), F.col("m"))).alias("p"), F.sum(F.when(F.col("new"), F.col("m"))).alias("c"), F.count_if(~F.col("new")).alias("pr"), F.count_if("new").alias("cr")
    )
    p, c, week = F.col("p").isNotNull(), F.col("c").isNotNull(), F.col("week")
    over, recent = pair.in_overlap(week), week.between(first, last)
    added, removed = c & ~p & over, p & ~c & over
    weeks = lambda cond: F.array_sort(F.collect_list(F.when(cond, week)))
    by_week = lambda cond, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(cond, F.struct(week, F.col(value))))))
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0))
    seen = weekly.groupBy("entity_type", "entity_id").agg(
        F.min(F.when(p, week)).alias("first_week_previous"), F.max(F.when(p, week)).alias("last_week_previous"), F.min(F.when(c, week)).alias("first_week_current"), F.max(F.when(c, week)).alias("last_week_current"),
        F.count_if(p).alias("week_count_previous"), F.count_if(c).alias("week_count_current"), F.sum("pr").alias("rows_previous"), F.sum("cr").alias("rows_current"),
        weeks(added).alias("historical_weeks_added"), weeks(removed).alias("historical_weeks_removed"), total(added, "c").alias("historical_value_added"), total(removed, "p").alias("historical_value_removed"),
        by_week(added, "c").alias("value_added_by_week"), by_week(removed, "p").alias("value_removed_by_week"),
        F.count_if(p & recent).alias("recent"), total(p & recent, "p").alias("recent_value"), F.coalesce(F.bool_or(p & (week == pair.previous_max_week)), F.lit(False)).alias("traded"), F.coalesce(F.bool_or(c & (week == pair.current_max_week)), F.lit(False)).alias("trades"),
    )
    had, has = F.col("week_count_previous") > 0, F.col("week_count_current") > 0
    gained, lost = F.size("historical_weeks_added") > 0, F.size("historical_weeks_removed") > 0
    missing = F.lit(pair.current_max_week in pair.new_periods and span > 0) & F.col("traded") & ~F.col("trades") & (F.col("recent") >= config.entity_presence_threshold * max(span, 1))
    kept = had & has
    classes = F.filter(
        F.array(F.when(had & ~has & lost, REMOVED), F.when(has & ~had, F.when(gained, NEW_BACKFILL).otherwise(NEW_RECENT)), F.when(kept & missing, LATEST_MISSING), F.when(kept & lost, TRUNCATED), F.when(kept & gained, EXTENDED)),
        lambda x: x.isNotNull(),
    )
    period = previous.where(F.col(config.week_column).between(first, last)).agg((F.coalesce(F.sum(metric), F.lit(0.0)) / max(span, 1)).alias("period_total"))
    found = seen.withColumn("classifications", classes).where(F.size("classifications") > 0).crossJoin(F.broadcast(period))
    absent = F.array_contains("classifications", LATEST_MISSING)
    return found.select(
        "entity_type", "entity_id", F.get("classifications", F.lit(0)).alias("classification"), "classifications", "first_week_previous", "last_week_previous", "first_week_current", "last_week_current", "week_count_previous", "week_count_current",
        "rows_previous", "rows_current", "historical_weeks_added", "historical_weeks_removed", "historical_value_added", "historical_value_removed", "value_added_by_week", "value_removed_by_week",
        F.when(absent, F.col("recent_value") / max(span, 1)).otherwise(0.0).alias("expected_value"), F.when(absent, F.col("period_total")).otherwise(0.0).alias("expected_period_total"),
    )


def absence_baseline(previous: DataFrame, config: DatasetConfig) -> DataFrame:
    """(entity_type, week, share): the share that the latest-week rule would have given at each recent week.

    No entity-by-week grid is made: only an entity's last present week before a gap can count, so the entity's own rows and
    a range frame over them suffice. The week index has one row per period and is broadcast.
    """
    columns = [c for c in config.entity_columns if c in previous.columns]
    span, count = config.entity_presence_window, config.entity_absence_baseline_weeks
    weeks = previous.where(F.col(config.week_column).isNotNull()).groupBy(F.col(config.week_column).alias("w")).agg(F.coalesce(F.sum(config.primary_metric), F.lit(0.0)).alias("total"))
    line = Window.orderBy("w")
    index = weeks.select("w", (F.row_number().over(line) - 1).alias("i"), F.sum("total").over(line.rowsBetween(-span, -1)).alias("window_total"))
    n = F.max("i").over(Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1
    tested = index.withColumn("n", n).where((F.col("i") >= F.greatest(F.lit(span + 1), F.col("n") - count)) & F.lit(count > 0))
    there = presence(previous, columns, config).where("value is not null").join(F.broadcast(index.select("w", "i")), F.col("week") == F.col("w"))
    own = Window.partitionBy("entity_type", "entity_id").orderBy("i")
    back = own.rangeBetween(-(span - 1), 0)
    gone = there.select("entity_type", (F.col("i") + 1).alias("at"), F.lead("i").over(own).alias("next"), F.count(F.lit(1)).over(back).alias("seen"), F.sum("value").over(back).alias("sum"))
    gone = gone.where((F.coalesce("next", F.lit(-1)) != F.col("at")) & (F.col("seen") >= config.entity_presence_threshold * span)).groupBy("entity_type", "at").agg(F.sum(F.abs(F.col("sum") / span)).alias("lost"))
    types = previous.sparkSession.createDataFrame([(entity_type(c),) for c in columns], "entity_type string")
    grid = F.broadcast(tested).crossJoin(F.broadcast(types)).withColumnRenamed("entity_type", "t")
    share = F.when(F.col("window_total") != 0, F.coalesce("lost", F.lit(0.0)) / (F.col("window_total") / span)).otherwise(0.0)
    return grid.join(gone, (F.col("t") == F.col("entity_type")) & (F.col("i") == F.col("at")), "left").select(F.col("t").alias("entity_type"), F.col("w").alias("week"), share.alias("share"))


def missing_impact(events: DataFrame, config: DatasetConfig, baseline: DataFrame | None = None) -> DataFrame:
    """Per entity type with absences: entities, expected loss and its share, the threshold, the baseline's maximum, material."""
    per = events.where(F.array_contains("classifications", LATEST_MISSING)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.abs(F.col("expected_value"))).alias("expected_lost"), F.max(F.abs(F.col("expected_period_total"))).alias("expected_period_total"))
    total = F.col("expected_period_total")
    per = per.withColumn("share", F.when(total != 0, F.col("expected_lost") / total)).withColumn("threshold", F.greatest(F.lit(float(config.materiality_abs)), config.materiality_ratio * total))
    if baseline is None:
        per = per.withColumn("baseline_weeks", F.lit(0).cast("long")).withColumn("baseline_max", F.lit(None).cast("double"))
    else:
        history = baseline.groupBy("entity_type").agg(F.count(F.lit(1)).alias("baseline_weeks"), F.when(F.count(F.lit(1)) >= MIN_BASELINE, F.max("share")).alias("baseline_max"))
        per = per.join(F.broadcast(history), "entity_type", "left").withColumn("baseline_weeks", F.coalesce("baseline_weeks", F.lit(0)))
    return per.withColumn("material", (F.col("expected_lost") > F.col("threshold")) & (F.col("baseline_max").isNull() | F.col("share").isNull() | (F.col("share") > F.col("baseline_max"))))


def category_map(df: DataFrame, dimension: DataFrame | None, side: str) -> DataFrame:
    """(product_id, category) of products with exactly one category; a dimension table decides where there is one."""
    if dimension is not None and {"product_id", "commodity_id"} <= set(dimension.columns):
        return dimension.select(F.col("product_id").cast("string").alias("product_id"), F.col("commodity_id").cast("string").alias(side)).dropDuplicates(["product_id"])
    per = df.groupBy(F.col("product_id").cast("string").alias("product_id")).agg(F.min(F.col("commodity_id").cast("string")).alias(side), F.max(F.col("commodity_id").cast("string")).alias("other"))
    return per.where(F.col(side) == F.col("other")).drop("other")


def reclassifications(previous: DataFrame, current: DataFrame, pair: VersionPair, config: DatasetConfig, previous_dim: DataFrame | None = None, current_dim: DataFrame | None = None) -> DataFrame:
    """One row per pair of categories between which products moved, with the value that moved and how much of it was conserved."""
    moved = category_map(previous, previous_dim, "from_commodity").join(category_map(current, current_dim, "to_commodity"), "product_id").where("from_commodity <> to_commodity")
    m, over = config.primary_metric, pair.in_overlap(F.col(config.week_column))
    tag = lambda df, new: df.where(over).groupBy(F.col("product_id").cast("string").alias("product_id"), F.col("commodity_id").cast("string").alias("commodity_id")).agg(F.coalesce(F.sum(m), F.lit(0.0)).alias("v")).withColumn("new", F.lit(new))
    values = tag(previous, False).unionByName(tag(current, True))
    sums = lambda: [F.coalesce(F.sum(F.when(~F.col("new"), F.col("v"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("new"), F.col("v"))), F.lit(0.0))]
    p, c = sums()
    by_product = values.groupBy("product_id").agg(p.alias("vp"), c.alias("vc"))
    by_category = values.groupBy("commodity_id").agg((c - p).alias("delta"))
    pairs = moved.join(by_product, "product_id", "left").groupBy("from_commodity", "to_commodity").agg(
        F.array_sort(F.collect_list("product_id")).alias("products"), F.count(F.lit(1)).alias("product_count"), F.coalesce(F.sum("vp"), F.lit(0.0)).alias("moved_previous"), F.coalesce(F.sum("vc"), F.lit(0.0)).alias("moved_current")
    )
    for side in ("from", "to"):
        pairs = pairs.join(by_category.select(F.col("commodity_id").alias(f"{side}_commodity"), F.col("delta").alias(f"{side}_delta")), f"{side}_commodity", "left")
    gross = F.greatest(F.abs("moved_previous"), F.abs("moved_current"))
    return pairs.select(
        F.concat_ws("->", "from_commodity", "to_commodity").alias("entity_id"), "from_commodity", "to_commodity", "products", "product_count", F.coalesce("from_delta", F.lit(0.0)).alias("from_delta"), F.coalesce("to_delta", F.lit(0.0)).alias("to_delta"),
        "moved_previous", "moved_current", gross.alias("gross_moved"), F.when(gross > 1e-9, 1 - F.abs(F.col("moved_current") - F.col("moved_previous")) / gross).otherwise(1.0).alias("conservation_ratio"),
    )


def all_events(previous: DataFrame, current: DataFrame, pair: VersionPair, config: DatasetConfig, previous_dim: DataFrame | None = None, current_dim: DataFrame | None = None) -> DataFrame:
    """Entity changes and category moves in one table; moves carry their details."""
    details = ["from_commodity", "to_commodity", "products", "product_count", "from_delta", "to_delta", "moved_previous", "moved_current", "gross_moved", "conservation_ratio"]
    changes = entity_changes(previous, current, pair, config)
    if not {"product_id", "commodity_id"} <= set(previous.columns) & set(current.columns):
        return changes
    moves = reclassifications(previous, current, pair, config, previous_dim, current_dim)
    moves = moves.select(
        F.lit("commodity").alias("entity_type"), "entity_id", F.lit(RECLASSIFIED).alias("classification"), F.array(F.lit(RECLASSIFIED)).alias("classifications"),
        F.col("moved_current").alias("historical_value_added"), F.col("moved_previous").alias("historical_value_removed"), F.array().cast("array<int>").alias("historical_weeks_added"), F.array().cast("array<int>").alias("historical_weeks_removed"),
        F.lit(0.0).alias("expected_value"), F.lit(0.0).alias("expected_period_total"), F.struct(*details).alias("details"),
    )
    return changes.unionByName(moves, allowMissingColumns=True)
