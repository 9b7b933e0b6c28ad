"""Cause labels from all events, however many; settings' rules."""

import pytest

from snapwarden.config import DatasetConfig, config_from
from snapwarden.functions import aggregates
from snapwarden.plans import approvals, assess, policy


def test_labels_see_every_event(spark):
    rows = [("ENTITY_HISTORY_TRUNCATED", "product", f"P{i:04d}") for i in range(300)] + [("LATEST_WEEK_MISSING", "store", "S001")]
    groups = assess.event_groups(spark.createDataFrame(rows, "classification string, entity_type string, entity_id string"))
    assert {(g.classification, g.count, len(g.ids)) for g in groups} == {("ENTITY_HISTORY_TRUNCATED", 300, assess.SHOWN), ("LATEST_WEEK_MISSING", 1, 1)}
    found = policy.labels(policy.Evidence(events=groups, material_absences=("store",)), DatasetConfig())
    assert [x.cause for x in found] == ["MISSING_STORES", "HISTORICAL_CORRECTION"]
    assert found[1].evidence[-1] == f"event:product:and {300 - assess.SHOWN} more"


@pytest.mark.parametrize(
    "evidence,causes",
    [
        ({"failed_contracts": ("warehouse:x",), "merged": (("a", "b"),), "n_merged": 1}, ["SCHEMA_FAILURE"]),
        ({"merged": (("a", "b"),), "n_merged": 3}, ["ENTITY_MERGE"]),
        ({"attribution": {"material": True, "explained_fraction": 0.1, "unexplained_delta": 20.0, "previous_total": 100.0}, "first_divergence": "coded"}, ["CODING"]),
        ({"attribution": {"material": True, "explained_fraction": 0.1, "unexplained_delta": 1.0, "previous_total": 100.0}, "first_divergence": "source"}, ["HISTORICAL_CORRECTION"]),
        ({"attribution": {"material": True, "explained_fraction": 0.1, "unexplained_delta": 1.0, "previous_total": 100.0}}, ["UNKNOWN"]),
        ({"attribution": {"material": False, "breadth": 0.9}}, ["HISTORICAL_CORRECTION"]),
        ({"restated_weeks": (5,), "first_divergence": "report"}, ["HISTORICAL_CORRECTION"]),
        ({"first_divergence": "warehouse"}, ["WAREHOUSE"]),
        ({"anomalies": ("national",)}, ["UNKNOWN"]),
        ({}, []),
    ],
)
def test_rules_speak_in_order(evidence, causes):
    assert [x.cause for x in policy.labels(policy.Evidence(**evidence), DatasetConfig())] == causes


def test_settings_rules():
    for bad in ({"calendar": "mapped"}, {"stage_keys": [["a", ["x"]], ["a", ["y"]]]}, {"hierarchy_intersections": [["a"]]}, {"primary_metric": "nope"}, {"temporal_lower_percentile": 0.99}, {"calendar_anchor_date": "2024-13-01"}, {"temporal_fdr_enabled": 1}, {"temporal_min_annual_history": 0}, {"temporal_fdr_q": 1.0}):
        with pytest.raises(ValueError):
            config_from(bad)
    c = DatasetConfig()
    assert c.required_temporal_metrics == ("dollar", "units") and c.optional_temporal_metrics == ("scripts", "stock")
    assert c.analysis_stages[0] == "warehouse" and c.contract_stages[0] == "report"


def test_refusals_are_told(spark):
    e = approvals.RatioExpectation("E", "d", "m", 1.0, 2.0, effective_from=10, effective_to=20, approved_by="a")
    flag = {"metric": "m", "week": 5, "ratio": 1.5}
    told = lambda as_of, change=None: approvals.apply_expectations([flag | (change or {})], [e], "d", as_of, spark)
    assert told("15")["expected"][0]["explained_by"] == "E" and told(None)["expected"]
    assert [told(a, c)["audit"][0]["reasons"][0] for a, c in (("9", None), ("21", None), ("2024-01-01", None), ("15", {"ratio": None}))] == ["E: not yet effective", "E: expired", "E: window of another kind", "E: outside the approved band"]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 1.0), (None, 4.0, 2.0), (None, None, 3.0)], "k string, v double, w double")
    assert {r.k: (r["median"], r.mad, r.n) for r in aggregates.median_and_mad(df, ["k"], "v").collect()} == {"a": (2.0, 1.0, 3), None: (4.0, 0.0, 1)}
    assert {r.k: r.correlation for r in aggregates.correlation(df, ["k"], "v", "w").collect()}["a"] is None
