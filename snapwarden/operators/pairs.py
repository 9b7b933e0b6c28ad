"""Pairs of versions: which to compare, and the shape of the difference in weeks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig

NORMAL, NO_NEW_WEEK, MULTIPLE_NEW_WEEKS, HISTORY_SHORTENED, HISTORY_EXTENDED = "NORMAL", "NO_NEW_WEEK", "MULTIPLE_NEW_WEEKS", "HISTORY_SHORTENED", "HISTORY_EXTENDED"


@dataclass(frozen=True)
class VersionPair:
    previous_id: str
    current_id: str
    previous_stage: str
    current_stage: str
    previous_min_week: int
    previous_max_week: int
    current_min_week: int
    current_max_week: int
    overlap_start: int
    overlap_end: int
    new_periods: tuple[int, ...]
    shape: str

    @property
    def overlap_weeks(self) -> range:
        return range(self.overlap_start, self.overlap_end + 1)

    def in_overlap(self, column) -> F.Column:
        """Weeks are contiguous by contract, so a range says it and lets Parquet skip row groups."""
        return column.between(self.overlap_start, self.overlap_end)


def week_bounds(previous: DataFrame, current: DataFrame, config: DatasetConfig) -> DataFrame:
    """One row: first and last week of both versions, and the current version's weeks after the previous one's last."""
    week = config.week_column
    last = previous.agg(F.max(week).alias("m"))
    sides = previous.select(F.lit(0).alias("s"), F.col(week).alias("w")).unionByName(current.select(F.lit(1).alias("s"), F.col(week).alias("w"))).crossJoin(F.broadcast(last))
    at = lambda s: F.when(F.col("s") == s, F.col("w"))
    new = F.array_sort(F.collect_set(F.when((F.col("s") == 1) & (F.col("w") > F.col("m")), F.col("w"))))
    return sides.agg(F.min(at(0)).alias("previous_min_week"), F.max(at(0)).alias("previous_max_week"), F.min(at(1)).alias("current_min_week"), F.max(at(1)).alias("current_max_week"), new.alias("new_periods"))


def shape_of(pmin: int, pmax: int, cmin: int, cmax: int, new: int) -> str:
    if not new:
        return NO_NEW_WEEK
    if cmin < pmin:
        return HISTORY_EXTENDED
    if cmin > pmin:
        return HISTORY_SHORTENED
    return MULTIPLE_NEW_WEEKS if new > 1 else NORMAL


def build_pair(previous: DataFrame, current: DataFrame, config: DatasetConfig, previous_id: str = "previous", current_id: str = "current", previous_stage: str | None = None, current_stage: str | None = None) -> VersionPair:
    r = week_bounds(previous, current, config).first()
    if r.previous_max_week is None or r.current_max_week is None:
        raise ValueError("a version without weeks can't be compared")
    pmin, pmax, cmin, cmax = r.previous_min_week, r.previous_max_week, r.current_min_week, r.current_max_week
    stage = config.analysis_stage
    return VersionPair(previous_id, current_id, previous_stage or stage, current_stage or stage, pmin, pmax, cmin, cmax, max(pmin, cmin), min(pmax, cmax), tuple(r.new_periods), shape_of(pmin, pmax, cmin, cmax, len(r.new_periods)))


def select_versions(versions: Sequence[str], current: str | None = None, previous: str | None = None) -> tuple[str, str]:
    """Previous and current version: by default the last two; never the same, reversed or unknown."""
    if len(versions) < 2:
        raise ValueError("two versions are needed")
    current = versions[-1] if current is None else current
    if current not in versions:
        raise ValueError(f"unknown version {current!r}")
    at = versions.index(current)
    if previous is None:
        if not at:
            raise ValueError(f"{current!r} has no predecessor")
        previous = versions[at - 1]
    if previous not in versions:
        raise ValueError(f"unknown version {previous!r}")
    if versions.index(previous) >= at:
        raise ValueError("the previous version must come before the current one")
    return previous, current


def common_stage(previous: Sequence[str], current: Sequence[str], preference: Sequence[str] = ()) -> str:
    """The first preferred stage that both versions have, else the last by name."""
    shared = set(previous) & set(current)
    if not shared:
        raise ValueError("the versions share no stage")
    return next((s for s in preference if s in shared), sorted(shared)[-1])
