"""Statistics against closed forms, and the latest-period assessment on seeded series."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig, replaced
from snapwarden.functions import stats
from snapwarden.functions.calendars import BusinessCalendar, easter
from snapwarden.operators import lifecycle, pairs
from snapwarden.plans import series

C = replaced(DatasetConfig(), metric_columns=("dollar",), unit_value_quantity="", snapshot_metrics=(), entity_columns=("banner_id",), entity_key_columns=("banner_id",), temporal_entity_columns=("banner_id",), report_grain=(), count_entity_map=(), hierarchy_columns=(), hierarchy_intersections=(), temporal_min_history=26)


@pytest.mark.parametrize("t,df,p", [(0, 10, 1.0), (2, 10, 0.07339), (3, 5, 0.03010), (-2.228, 10, 0.05)])
def test_student_t(t, df, p):
    assert stats.t_two_sided(t, df) == pytest.approx(p, abs=2e-4)


def test_quantiles_and_intervals():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3) and stats.t_quantile(0.025, 10) == pytest.approx(-2.2281, abs=1e-3)
    assert stats.wilson(72, 72)[0] == pytest.approx(0.949, abs=1e-3) and stats.wilson(1, 60)[1] == pytest.approx(0.089, abs=1e-3) and stats.wilson(0, 0) == (0.0, 1.0)
    assert stats.minimum_samples(0.1) == 9 and stats.minimum_samples(0.01) == 99
    assert stats.conformal_interval([1.0] * 8, 0.0, 0.1).status == "INSUFFICIENT_CALIBRATION"
    got = stats.conformal_interval(list(range(1, 10)), 5.0, 0.1)
    assert (got.lower, got.upper, got.width) == (-4.0, 14.0, 18.0)
    assert stats.leave_one_out_coverage([1.0], 0.1) is None


def test_z_scores():
    v = [10.0, 12.0, 11.0, 9.0, 10.0, 11.0, 12.0, 10.0]
    assert stats.robust_z(v, 10.5, 8) == 0.0 and stats.robust_z([5.0] * 9, 9.0, 5) == 0.0
    assert stats.seasonal_z([1, 53, 105], [10.0, 12.0, 11.0], 157, 20.0, 52) == pytest.approx(9 / 1.4826)
    assert stats.ewma_z([1.0], 2.0, 13) == 0.0 and stats.change_point([1.0] * 7, 26) == 0.0
    assert stats.change_point([1.0, 1.1, 0.9, 1.0, 5.0, 5.1, 4.9, 5.0], 26) > 20


def test_calendar():
    assert [easter(y) for y in (1995, 2000, 2018, 2024, 2038)] == [date(1995, 4, 16), date(2000, 4, 23), date(2018, 4, 1), date(2024, 3, 31), date(2038, 4, 25)]
    c = BusinessCalendar(date(2024, 1, 1), 1, (("easter", "easter", 1, 0), ("leap", "02-29", 0, 0)))
    assert c.week_for(date(2024, 1, 8)) == 2 and c.week_start(2) == date(2024, 1, 8) and c.is_53_week_year(2020)
    assert c.event_weeks(1, 60) == {"easter": {12, 13}, "leap": {9}}


def share(leaf_last, parent_last, weeks=60):
    rng = random.Random(5)
    parent = {w: 1000 + 100 * math.sin(w / 5) for w in range(1, weeks)}
    child = {w: v * (0.2 + rng.gauss(0, 0.002)) for w, v in parent.items()}
    return series.share_test(child, parent, leaf_last, parent_last, weeks, 26)


def test_share_test_tells_the_leaf_from_the_market():
    common = share(0.2 * 700, 700)
    own = share(0.2 * 1000 * 0.8, 1000 - 40)
    assert common.p > 0.05 and own.p < 1e-6 and own.impact < 0 and share(1.0, 0.0) is None


def test_sustained_share_test_needs_every_week():
    parent = {w: 1000.0 for w in range(1, 100)}
    rng = random.Random(1)
    child = {w: 200 + rng.gauss(0, 5) for w in range(1, 100)}
    assert series.share_test(child, parent, 200, 1000, 100, 26, recent=4) is not None
    child.pop(99)
    assert series.share_test(child, parent, 200, 1000, 100, 26, recent=4) is None


def feed(spark, last, change=None, weeks=120, drop=1.0):
    """Three banners with season and noise; the last week may move."""
    rng = random.Random(3)
    rows = []
    for w in range(1, weeks + 1):
        market = 100 * (1 + 0.1 * math.sin(2 * math.pi * w / 52)) * (drop if w == weeks else 1.0)
        for b, part in (("b1", 0.5), ("b2", 0.3), ("b3", 0.2)):
            v = market * part * (1 + rng.gauss(0, 0.01))
            rows.append((w, b, v * (change if change and w == weeks and b == "b3" else 1.0)))
    return spark.createDataFrame([r for r in rows if r[0] <= last], "week int, banner_id string, dollar double")


def judged(spark, config=C, **how):
    p, c = feed(spark, 119), feed(spark, 120, **how)
    pair = pairs.build_pair(p, c, config)
    events = lifecycle.entity_changes(p, c, pair, config)
    return {r.series_id: r for r in series.assess_latest(p, c, pair, events, config).collect()}


def test_a_quiet_week_raises_nothing(spark):
    got = judged(spark)
    assert len(got) == 4 and not any(r.anomaly for r in got.values()) and all(r.reason is None for r in got.values())
    assert all(r.calibration_status == "OK" and r.interval_lower < r.point < r.interval_upper for r in got.values() if r.level != "national") or got["national"].pool_n == 12


def test_one_banner_falls(spark):
    got = judged(spark, change=0.6)
    assert got["banner_id:b3"].anomaly and got["banner_id:b3"].decided_by == "share_shift" and "share_shift" in got["banner_id:b3"].flags


def test_the_market_falls(spark):
    got = judged(spark, drop=0.4)
    assert got["national"].anomaly and got["national"].decided_by == "forecast_lower" and not got["banner_id:b1"].anomaly


def test_training_never_sees_the_target(spark):
    a, b = judged(spark), judged(spark, change=0.01)
    assert a["banner_id:b3"].point == b["banner_id:b3"].point and a["banner_id:b3"].calibration_z == b["banner_id:b3"].calibration_z


def test_model_selection(spark):
    got = judged(spark, replaced(C, forecaster="auto"))
    assert got["national"].model.startswith(("ridge", "naive")) and not got["national"].anomaly


def test_new_vanished_and_dormant_series(spark):
    p, c = feed(spark, 119), feed(spark, 120)
    p = p.where("not (banner_id = 'b2' and week > 100)")
    c = c.where("not (banner_id = 'b3' and week = 120) and not (banner_id = 'b2' and week > 100)").unionByName(spark.createDataFrame([(120, "b9", 5.0)], "week int, banner_id string, dollar double"))
    pair = pairs.build_pair(p, c, C)
    events = lifecycle.entity_changes(p, c, pair, C)
    got = {r.series_id: r for r in series.assess_latest(p, c, pair, events, C).collect()}
    assert {k: (r.reason, r.required) for k, r in got.items() if r.reason} == {"banner_id:b2": ("dormant series", False), "banner_id:b3": ("vanished series", False), "banner_id:b9": ("new series", False)}
    assert got["national"].adjustment == 5.0


def test_sparse_leaf_takes_its_share_of_the_parent(spark):
    b1 = [(w, "b1", 100.0 + w % 3) for w in range(1, 42)]
    b2 = [(w, "b2", 50.0) for w in range(31, 42)]
    make = lambda last: spark.createDataFrame([r for r in b1 + b2 if r[0] <= last], "week int, banner_id string, dollar double")
    p, c = make(40), make(41)
    pair = pairs.build_pair(p, c, C)
    got = {r.series_id: r for r in series.evidence(p, c, pair, lifecycle.entity_changes(p, c, pair, C), C).collect()}
    assert got["banner_id:b2"].support == "parent_share" and got["banner_id:b2"].point == pytest.approx(got["national"].point * 500 / (sum(v for w, _, v in b1 if 31 <= w <= 40) + 500))


def test_dense_series_marks_gaps(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "b", 2.0), (4, "b", 4.0)], "week int, banner_id string, dollar double")
    got = {r.week: r.missing for r in series.dense_series(df, C, ["dollar"]).where("series_id = 'national'").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_sensitivity(spark):
    p, c = feed(spark, 119), feed(spark, 120)
    pair = pairs.build_pair(p, c, C)
    decided = series.assess_latest(p, c, pair, lifecycle.entity_changes(p, c, pair, C), C)
    got = series.sensitivity(decided, C)
    assert len(got) == 1 and 0.02 <= got[0]["median_change"] < 0.3
