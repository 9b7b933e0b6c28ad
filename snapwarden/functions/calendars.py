"""Business calendar: weeks and dates, retail years, and the weeks of declared events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar, from the golden number, the epact and the Sunday letter."""
    golden, century = year % 19 + 1, year // 100 + 1
    skipped, moon = 3 * century // 4 - 12, (8 * century + 5) // 25 - 5
    sunday = 5 * year // 4 - skipped - 10
    epact = (11 * golden + 20 + moon - skipped) % 30
    if epact == 24 or (epact == 25 and golden > 11):
        epact += 1
    full = 44 - epact
    full += 30 if full < 21 else 0
    day = full + 7 - (sunday + full) % 7
    return date(year, 3, 1) + timedelta(days=day - 1)


@dataclass(frozen=True)
class BusinessCalendar:
    anchor_date: date
    anchor_week: int
    events: tuple[tuple[str, str, int, int], ...] = ()

    def week_start(self, week: int) -> date:
        return self.anchor_date + timedelta(weeks=week - self.anchor_week)

    def week_for(self, day: date) -> int:
        return self.anchor_week + (day - self.anchor_date).days // 7

    def retail_year_week(self, week: int) -> tuple[int, int]:
        return tuple(self.week_start(week).isocalendar()[:2])

    def weeks_in_year(self, year: int) -> int:
        return date(year, 12, 28).isocalendar()[1]

    def is_53_week_year(self, year: int) -> bool:
        return self.weeks_in_year(year) == 53

    def event_dates(self, rule: str, year: int) -> date | None:
        if rule == "easter":
            return easter(year)
        month, day = map(int, rule.split("-"))
        try:
            return date(year, month, day)
        except ValueError:  # 29 February
            return None

    def event_weeks(self, first: int, last: int) -> dict[str, set[int]]:
        """Weeks of each event in a range, with its lead and lag."""
        years = range(self.week_start(first).year - 1, self.week_start(last).year + 2)
        out: dict[str, set[int]] = {}
        for name, rule, lead, lag in self.events:
            own = out.setdefault(name, set())
            for day in filter(None, (self.event_dates(rule, y) for y in years)):
                w = self.week_for(day)
                own |= {k for k in range(w - lead, w + lag + 1) if first <= k <= last}
        return out

    def frame(self, spark: SparkSession, first: int, last: int) -> DataFrame:
        """(week, week_start, retail_year, retail_week, events) of a range: one row per period, to be broadcast."""
        found = self.event_weeks(first, last)
        rows = [(w, self.week_start(w), *self.retail_year_week(w), sorted(n for n, own in found.items() if w in own)) for w in range(first, last + 1)]
        return spark.createDataFrame(rows, "week int, week_start date, retail_year int, retail_week int, events array<string>")

    def identity(self) -> dict[str, Any]:
        return {"anchor_date": self.anchor_date.isoformat(), "anchor_week": self.anchor_week, "events": [list(e) for e in self.events]}


def build_calendar(config: DatasetConfig) -> BusinessCalendar | None:
    if not config.calendar_anchor_date:
        return None
    return BusinessCalendar(date.fromisoformat(config.calendar_anchor_date), config.calendar_anchor_week, config.calendar_events)


def calendar_identity(config: DatasetConfig) -> dict[str, Any]:
    calendar = build_calendar(config)
    return {"calendar": config.calendar} | (calendar.identity() if calendar else {})


def epoch_week(day: Column) -> Column:
    """Whole weeks since 1970-01-01."""
    return F.floor(F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")) / 7).cast("int")
