"""Replacement candidates: removed entities whose weekly series an added entity goes on with."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig
from snapwarden.operators.lifecycle import _entities, shared_entities
from snapwarden.operators.pairs import VersionPair

#: One-sided entities that are broadcast; with more of them, weekly sums of all entities are joined with them.
FEW = 500_000
#: Entities of a block, and those of it that are correlated with another block at a time.
BLOCK, STRIP = 2048, 256


def benjamini_hochberg(df: DataFrame, q: float, p: str = "p_value", keys: Sequence[str] = ()) -> DataFrame:
    """df with adjusted_p and significant; a family for each value of ``keys``. A null p-value is no test.

    A p-value's adjusted value depends on how many are at most as large, so rows are counted by distinct p-value first, and
    these by bins of their logarithm: a task sees one bin, and one task the few thousand bins. Ties share a value.
    """
    by = [*keys, "_p"]
    bin_ = F.coalesce(F.floor(F.log2(F.when(F.col("_p") > 0, F.col("_p"))) * 64).cast("int"), F.lit(-(2**30)))
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", bin_)
    family = Window.partitionBy(*(keys or [F.lit(0)]))
    below, above = family.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1), family.orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("_bn").over(below), F.lit(0)).alias("_base"), F.sum("_bn").over(family).alias("_m"))
    match = lambda left, right, names: [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in names]
    own = Window.partitionBy(*keys, "_bin").orderBy("_p")
    ranked = counts.alias("c").join(F.broadcast(bins).alias("b"), match("c", "b", [*keys, "_bin"])).select(*[F.col(f"c.{k}").alias(k) for k in by], F.col("c._bin").alias("_bin"), "_n", "_base", "_m")
    raw = F.col("_p") * F.col("_m") / (F.col("_base") + F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_raw", raw)
    least = ranked.groupBy(*keys, "_bin").agg(F.min("_raw").alias("_least"))
    later = least.select(*keys, "_bin", F.min("_least").over(above).alias("_later"))
    inner = ranked.withColumn("_here", F.min("_raw").over(own.rowsBetween(0, Window.unboundedFollowing)))
    done = inner.alias("i").join(F.broadcast(later).alias("l"), match("i", "l", [*keys, "_bin"])).select(*[F.col(f"i.{k}").alias(f"_k_{k}") for k in by], F.least(F.lit(1.0), F.col("_here"), F.coalesce("_later", F.lit(1.0))).alias("adjusted_p"))
    on = [F.col(p) == F.col("_k__p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return df.join(done, on, "left").drop(*[f"_k_{k}" for k in by]).withColumn("significant", F.coalesce(F.col("adjusted_p") <= q, F.lit(False)))


def one_sided(previous: DataFrame, current: DataFrame, columns: list[str], pair: VersionPair, config: DatasetConfig, kept: list[DataFrame] | None = None) -> DataFrame:
    """Active weeks and values of entities that only one version has: (entity_type, entity_id, new, week, v).

    Which entities these are is found first. Up to FEW of them are broadcast, so that rows of all others go before anything
    is summed or dealt out; more of them meet the sums by week in a join, with the same result.
    """
    week, m = config.week_column, config.primary_metric
    side = lambda df, new: df.select(_entities(columns).alias("e"), F.col(week).alias("week"), F.col(m).alias("m"), F.lit(new).alias("new"))
    both = side(previous, False).unionByName(side(current, True)).select("e.entity_type", "e.entity_id", "new", "week", "m").where("entity_id is not null")
    alone = both.groupBy("entity_type", "entity_id").agg(F.min("new").alias("least"), F.max("new").alias("most")).where("least = most").select("entity_type", "entity_id")
    alone = _once(alone, kept)
    few = alone.limit(FEW + 1).count() <= FEW
    rows = both.where(pair.in_overlap(F.col("week")))
    if few:
        rows = rows.join(F.broadcast(alone), ["entity_type", "entity_id"], "left_semi")
    weekly = rows.groupBy("entity_type", "entity_id", "new", "week").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("v")).where("v <> 0")
    return weekly if few else weekly.join(alone, ["entity_type", "entity_id"], "left_semi")


def replacement_candidates(previous: DataFrame, current: DataFrame, pair: VersionPair, config: DatasetConfig, kept: list[DataFrame] | None = None) -> DataFrame:
    """(entity_type, source_id, target_id, correlation, ratio, active_weeks): correlated pairs of like volume.

    A pair's volumes differ by at most the ratio bounds, so entities meet only in steps of the volume's logarithm that these
    bounds span. An entity is one row with its weeks and values. The entities of a step are dealt into blocks of some BLOCK
    rows; a task lays a block of old and one of new entities out by week and correlates all their pairs by one product of
    matrices, so only pairs that are found leave it: no row per pair and week is ever made. With ``kept`` what is read
    twice is computed once and persisted; the caller releases what is appended there.
    """
    columns = shared_entities(previous, current, config)
    low, high = config.relationship_ratio_bounds
    weekly = one_sided(previous, current, columns, pair, config, kept)
    series = weekly.groupBy("entity_type", "entity_id", "new").agg(F.sum("v").alias("s"), F.collect_list(F.struct((F.col("week") - pair.overlap_start).cast("int").alias("at"), F.col("v").cast("double").alias("v"))).alias("cells"))
    series = series.where((F.size("cells") >= config.relationship_min_weeks) & (F.abs("s") > 1e-12))
    step = lambda x: F.floor(F.log2(F.abs(x))).cast("int")
    steps = F.when(F.col("new"), F.array(step(F.col("s")))).otherwise(F.sequence(step(F.col("s") * low * (1 - 1e-9)), step(F.col("s") * high * (1 + 1e-9))))
    stepped = _once(series.select("entity_type", "entity_id", "new", F.explode(steps).alias("step"), "cells.at", "cells.v"), kept)
    blocks = lambda cond: F.ceil(F.count_if(cond) / BLOCK).cast("int")
    sizes = stepped.groupBy("entity_type", "step").agg(blocks(~F.col("new")).alias("olds"), blocks(F.col("new")).alias("news")).where("olds > 0 and news > 0")
    # One row for each entity type and step of the logarithm, so a bounded broadcast.
    dealt = stepped.join(F.broadcast(sizes), ["entity_type", "step"])
    own = F.pmod(F.xxhash64("entity_id"), F.when(F.col("new"), F.col("news")).otherwise(F.col("olds"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("new"), F.col("olds")).otherwise(F.col("news")) - 1)))
    dealt = dealt.select("entity_type", "step", F.when(F.col("new"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("new"), F.col("own")).otherwise(F.col("other")).alias("j"), "new", "entity_id", "at", "v")
    found = _correlated(len(pair.overlap_weeks), low, high, config.relationship_correlation_threshold)
    return dealt.groupBy("entity_type", "step", "i", "j").applyInArrow(found, "entity_type string, source_id string, target_id string, correlation double, ratio double, active_weeks long")


def _correlated(n: int, low: float, high: float, least: float):
    """A block of old and one of new entities → their pairs with a ratio in bounds and at least that correlation over n weeks."""

    def laid(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, sums, active weeks and which series vary, and the series by week, centred and of length 1."""
        rows = rows.sort_by("entity_id").combine_chunks()  # rows come in any order, which must not show in the last digits
        at, v = (rows[c].combine_chunks() for c in ("at", "v"))
        lengths = at.value_lengths().to_numpy()
        grid = np.zeros((rows.num_rows, n))
        grid[np.repeat(np.arange(rows.num_rows), lengths), at.flatten().to_numpy()] = v.flatten().to_numpy()
        sums = grid.sum(axis=1)
        grid -= sums[:, None] / n
        squares = np.einsum("ij,ij->i", grid, grid)
        varies = squares / n > 1e-24
        grid /= np.sqrt(np.where(varies, squares, 1.0))[:, None]
        return rows["entity_id"].to_pylist(), sums, lengths, varies, grid

    def run(rows: pa.Table) -> pa.Table:
        new = rows["new"]
        x_ids, sx, ax, fx, x = laid(rows.filter(pc.invert(new)))
        y_ids, sy, ay, fy, y = laid(rows.filter(new))
        a, b, corr, ratios = [], [], [], []
        for k in range(0, len(x_ids), STRIP):
            c, r = x[k : k + STRIP] @ y.T, sy[None, :] / sx[k : k + STRIP, None]
            p, q = np.nonzero((c >= least) & (r >= low) & (r <= high) & fx[k : k + STRIP, None] & fy[None, :])
            a.append(p + k)
            b.append(q)
            corr.append(np.minimum(c[p, q], 1.0))
            ratios.append(r[p, q])
        p, q = (np.concatenate([np.zeros(0, np.int64), *d]) for d in (a, b))
        ids = lambda names, where: pa.array(names, pa.string()).take(pa.array(where))
        columns = [pa.repeat(rows["entity_type"][0], len(p)), ids(x_ids, p), ids(y_ids, q), *(pa.array(np.concatenate([np.zeros(0), *d])) for d in (corr, ratios)), pa.array(np.minimum(ax[p], ay[q]).astype(np.int64))]
        return pa.Table.from_arrays(columns, ["entity_type", "source_id", "target_id", "correlation", "ratio", "active_weeks"])

    return run


def _once(df: DataFrame, kept: list[DataFrame] | None) -> DataFrame:
    """df, persisted and noted where someone will release it."""
    if kept is None:
        return df
    kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return kept[-1]


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 to 1.2e-7, by a rational Chebyshev fit; it stays inside generated code."""
    t = 1 / (1 + 0.5 * x)
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    series: Column = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        series = F.lit(c) + t * series
    return t * F.exp(-x * x + series)


def replacements(previous: DataFrame, current: DataFrame, pair: VersionPair, config: DatasetConfig, q: float = 0.05, kept: list[DataFrame] | None = None) -> DataFrame:
    """Candidates that stay significant together, by Fisher's z and Benjamini-Hochberg, which reads them several times."""
    n = len(pair.overlap_weeks)
    if n < config.relationship_min_weeks:
        return replacement_candidates(previous, current, pair, config).withColumns({"p_value": F.lit(1.0), "adjusted_p": F.lit(1.0), "significant": F.lit(False)}).limit(0)
    found = _once(replacement_candidates(previous, current, pair, config, kept), kept)
    z = F.atanh(F.when(F.abs("correlation") < 1 - 1e-15, F.col("correlation"))) * max(n - 3, 0) ** 0.5
    tested = found.withColumn("p_value", F.coalesce(erfc(F.abs(z) / 2**0.5), F.lit(0.0)) if n >= 4 else F.lit(1.0))
    return benjamini_hochberg(tested, q).where("significant")
