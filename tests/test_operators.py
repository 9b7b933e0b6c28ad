"""Operators on hand-built frames with exact expected values."""

import pytest
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig, config_from, replaced
from snapwarden.operators import attribution, checks, contracts, cubes, fingerprints, lifecycle, pairs, relationships

C = replaced(DatasetConfig(), metric_columns=("dollar", "units"), snapshot_metrics=(), entity_columns=("store_id", "product_id", "commodity_id"), entity_key_columns=("store_id",), report_grain=(), count_entity_map=(), hierarchy_columns=(("store_id",),), hierarchy_intersections=())


def frame(spark, rows, schema="week int, store_id string, dollar double, units double"):
    return spark.createDataFrame(rows, schema)


def store(spark, weeks, dollar=10.0, ids="S1"):
    return frame(spark, [(w, i, dollar, dollar / 5) for i in ids.split() for w in weeks])


def names(found):
    return {c.name for c in found if not c.passed}


def test_config_refuses_what_makes_no_sense():
    for bad in ({"name": "a b"}, {"materiality_ratio": -1}, {"entity_presence_threshold": 2.0}, {"primary_metric": "stock"}, {"entity_key_columns": ["week"]}, {"forecast_quantiles": [0.5, 0.1]}, {"calendar_events": [["x", "13-1", 0, 0]]}, {"temporal_window": 0}, {"nonsense": 1}, {"relationship_ratio_bounds": [2, 1]}):
        with pytest.raises(ValueError):
            config_from(bad)
    assert config_from({"price_reference_weeks": 0, "column_map": [["week", "wk"]]}).source_rename == {"wk": "week"}


def test_clean_contracts_pass(spark):
    df = store(spark, (1, 2))
    assert not names(contracts.validate(df, df, C))


@pytest.mark.parametrize(
    "make,failed",
    [
        (lambda s: store(s, (1, 2)).drop("dollar"), {"required_columns", "compatible_schema"}),
        (lambda s: store(s, (1, 2)).withColumn("dollar", F.col("dollar").cast("string")), {"metric_dtypes"}),
        (lambda s: store(s, (1, 3)), {"week_progression"}),
        (lambda s: store(s, (1, 2)).unionByName(store(s, (2,))), {"duplicate_keys", "duplicate_fraction"}),
        (lambda s: store(s, (1, 2)).withColumn("units", F.when(F.col("week") == 1, F.lit(float("inf"))).otherwise(F.col("units"))), {"finite_measures"}),
        (lambda s: store(s, (1, 2)).withColumn("units", F.when(F.col("week") == 1, F.col("units"))), {"finite_measures", "null_fraction"}),
        (lambda s: store(s, (1, 2)).withColumn("store_id", F.when(F.col("week") == 1, F.col("store_id"))), {"key_nulls"}),
        (lambda s: store(s, (1, 2)).limit(0), {"week_progression", "latest_week_present"}),
    ],
)
def test_each_contract_can_fail(spark, make, failed):
    assert names(contracts.validate(make(spark), store(spark, (1, 2)), C)) == failed
    assert "previous:" + sorted(failed - {"compatible_schema"})[0] in names(contracts.validate(store(spark, (1, 2)), make(spark), C))


@pytest.mark.parametrize("a,b,shape", [((1, 2, 3), (1, 2, 3, 4), "NORMAL"), ((1, 2), (1, 2), "NO_NEW_WEEK"), ((1, 2), (1, 2, 3, 4), "MULTIPLE_NEW_WEEKS"), ((1, 2, 3, 4), (2, 3, 4, 5), "HISTORY_SHORTENED"), ((2, 3), (1, 2, 3, 4), "HISTORY_EXTENDED")])
def test_version_shapes(spark, a, b, shape):
    pair = pairs.build_pair(store(spark, a), store(spark, b), C)
    assert pair.shape == shape and list(pair.new_periods) == [w for w in b if w > max(a)] and list(pair.overlap_weeks) == sorted(set(range(max(min(a), min(b)), min(max(a), max(b)) + 1)))


def test_select_versions():
    assert pairs.select_versions(["a", "b", "c"]) == ("b", "c") and pairs.select_versions(["a", "b", "c"], "c", "a") == ("a", "c")
    for args in ((["a"],), (["a", "b"], "b", "b"), (["a", "b"], "a", "b"), (["a", "b"], "x"), (["a", "b"], "a")):
        with pytest.raises(ValueError):
            pairs.select_versions(*args)


def test_revision_cube(spark):
    p = frame(spark, [(1, "A", 10.0, 1.0), (1, "B", 0.0, 0.0), (2, None, 12.0, 2.0), (2, "C", 10.0, None)])
    c = frame(spark, [(1, "A", 12.0, 1.0), (1, "B", 5.0, 1.0), (2, None, 5.0, 2.0), (3, "A", 7.0, 1.0)])
    got = {(r.week, r.store_id): r for r in cubes.revision_cube(p, c, ["week", "store_id"], C, [3]).collect()}
    assert len(got) == 5
    assert (got[1, "A"].dollar_delta, got[1, "A"].dollar_relative) == (2.0, 0.2)
    assert got[1, "B"].dollar_relative is None and got[2, None].dollar_delta == -7.0
    assert (got[2, "C"].dollar_current, got[2, "C"].dollar_delta) == (0.0, -10.0)
    assert (got[3, "A"].period, got[1, "A"].period, got[3, "A"].dollar_previous) == ("new", "overlap", 0.0)
    strict = cubes.revision_cube(p, c, ["week", "store_id"], replaced(C, absent_entity_policy="missing"), [3])
    assert {(r.week, r.store_id): r.dollar_delta for r in strict.collect()}[2, "C"] is None
    assert tuple(cubes.cube_summary(cubes.revision_cube(p, c, ["week", "store_id"], C, [3]), "dollar").first()) == (32.0, 22.0, -10.0)
    with pytest.raises(ValueError):
        cubes.revision_cube(p, c, ["week", "nope"], C, [3])


def test_counts_are_distinct_entities(spark):
    k = replaced(C, count_entity_map=(("store_count", "store_id"),))
    df = store(spark, (1,), ids="A B").withColumn("store_count", F.lit(1))
    assert cubes.aggregate(df, ["week"], k).first().store_count == 2
    assert cubes.aggregate(df.drop("store_id"), ["week"], k).first().store_count == 2


def lives(spark):
    p = store(spark, range(1, 11), ids="A").unionByName(store(spark, range(1, 11), ids="D F")).unionByName(store(spark, range(8, 11), 3.0, "C"))
    c = store(spark, range(1, 12), ids="A").unionByName(store(spark, range(1, 11), ids="F")).unionByName(store(spark, range(3, 12), ids="D")).unionByName(store(spark, (5, 6, 11), 4.5, "B")).unionByName(store(spark, (11,), ids="G"))
    return p, c, pairs.build_pair(p, c, C)


def test_lifecycles(spark):
    p, c, pair = lives(spark)
    got = {r.entity_id: r for r in lifecycle.entity_changes(p, c, pair, C).collect()}
    assert {k: list(v.classifications) for k, v in got.items()} == {"B": [lifecycle.NEW_BACKFILL], "C": [lifecycle.REMOVED], "D": [lifecycle.TRUNCATED], "F": [lifecycle.LATEST_MISSING], "G": [lifecycle.NEW_RECENT]}
    assert got["B"].historical_value_added == 9.0 and got["B"].value_added_by_week == {5: 4.5, 6: 4.5}
    assert got["C"].historical_value_removed == 9.0 and list(got["D"].historical_weeks_removed) == [1, 2]
    assert got["F"].expected_value == 10.0 and got["F"].expected_period_total == pytest.approx(30 + 9 / 8)


def test_null_values_are_no_presence(spark):
    p = store(spark, (1, 2, 3))
    c = p.withColumn("dollar", F.when(F.col("week") != 2, F.col("dollar"))).unionByName(store(spark, (4,)))
    got = lifecycle.entity_changes(p, c, pairs.build_pair(p, c, C), C).first()
    assert got.classification == lifecycle.TRUNCATED and list(got.historical_weeks_removed) == [2]


def test_absence_baseline_and_impact(spark):
    weeks = range(1, 31)
    df = store(spark, weeks, 90.0, "BIG").unionByName(store(spark, [w for w in weeks if w % 6], 10.0, "GAP"))
    base = {r.week: r.share for r in lifecycle.absence_baseline(df, C).where("entity_type = 'store'").collect()}
    assert sorted(base) == list(range(10, 31))
    assert all((base[w] > 0) == (w % 6 == 0) for w in base) and 0.08 < base[12] < 0.12
    c = store(spark, range(1, 32), 90.0, "BIG").unionByName(store(spark, [w for w in weeks if w % 6], 10.0, "GAP"))
    sparse = df.where("not (store_id = 'GAP' and week = 30)").unionByName(store(spark, (30,), 10.0, "GAP"))
    events = lifecycle.entity_changes(sparse, c, pairs.build_pair(sparse, c, C), C)
    plain = lifecycle.missing_impact(events, C).first()
    judged = lifecycle.missing_impact(events, C, lifecycle.absence_baseline(sparse, C)).first()
    assert plain.material and plain.entities == 1 and judged.baseline_max is not None


def test_reclassification(spark):
    schema = "week int, product_id string, commodity_id string, dollar double, units double"
    p = frame(spark, [(w, x, c, 10.0, 1.0) for w in (1, 2) for x, c in (("P1", "C1"), ("P2", "C1"), ("P3", "C2"))], schema)
    c = p.withColumn("commodity_id", F.when(F.col("product_id") == "P1", "C2").otherwise(F.col("commodity_id"))).unionByName(frame(spark, [(3, "P3", "C2", 9.0, 1.0)], schema))
    pair = pairs.build_pair(p, c, C)
    r = lifecycle.reclassifications(p, c, pair, C).collect()
    assert len(r) == 1 and (r[0].entity_id, r[0].products, r[0].from_delta, r[0].to_delta, r[0].conservation_ratio) == ("C1->C2", ["P1"], -20.0, 20.0, 1.0)
    dims = [spark.createDataFrame([("P1", x)], "product_id string, commodity_id string") for x in ("C7", "C8")]
    assert lifecycle.reclassifications(p, c, pair, C, *dims).first().entity_id == "C7->C8"


def test_replacement(spark):
    wave = [10.0, 14.0, 9.0, 20.0, 11.0, 16.0]
    rows = lambda i, scale=1.0: [(w + 1, i, v * scale, 1.0) for w, v in enumerate(wave)]
    flat = [(w, "B", 50.0, 1.0) for w in range(1, 7)]
    p, c = frame(spark, rows("A") + flat), frame(spark, rows("C", 1.1) + flat + [(7, "B", 50.0, 1.0), (7, "C", 9.0, 1.0)])
    got = relationships.replacements(p, c, pairs.build_pair(p, c, C), C).collect()
    assert [(r.source_id, r.target_id) for r in got] == [("A", "C")] and got[0].correlation == pytest.approx(1.0) and got[0].ratio == pytest.approx(1.1)
    small = frame(spark, rows("C", 5.0) + flat + [(7, "B", 50.0, 1.0)])
    assert relationships.replacements(p, small, pairs.build_pair(p, small, C), C).count() == 0


def brute_replacements(p, c, n):
    """Correlated pairs of gone and fresh stores over the weeks 1 to n, from all pairs."""
    series = lambda df: {r.store_id: r.s for r in df.groupBy("store_id").agg(F.collect_list(F.struct("week", "dollar")).alias("s")).collect()}
    old, new, want = series(p), series(c), {}
    for a in set(old) - set(new):
        for b in set(new) - set(old):
            x, y = ([dict(s).get(w, 0.0) for w in range(1, n + 1)] for s in (old[a], [t for t in new[b] if t[0] <= n]))
            mx, my = sum(x) / n, sum(y) / n
            sxy, sxx, syy = (sum((u - mu) * (v - mv) for u, v in zip(d, e, strict=True)) for d, mu, e, mv in ((x, mx, y, my), (x, mx, x, mx), (y, my, y, my)))
            if sxx > 1e-9 and syy > 1e-9 and sxy / (sxx * syy) ** 0.5 >= 0.9 and 0.5 <= sum(y) / sum(x) <= 2:
                want[a, b] = (round(sxy / (sxx * syy) ** 0.5, 9), round(sum(y) / sum(x), 9), min(sum(map(bool, x)), sum(map(bool, y))))
    return want


@pytest.mark.parametrize("few,block", [(500_000, 2048), (500_000, 3), (0, 3)])
def test_replacements_of_many_entities_make_no_row_per_pair_and_week(spark, monkeypatch, few, block):
    """All pairs as by brute force, whatever the blocks and the way to one-sided entities; no operator gives out a row per pair and week."""
    import random

    monkeypatch.setattr(relationships, "FEW", few)
    monkeypatch.setattr(relationships, "BLOCK", block)
    rng, n = random.Random(4), 12
    waves = [[rng.choice([0.0, rng.uniform(1, 30)]) for _ in range(n)] for _ in range(6)]
    made = lambda kind, count: [(w + 1, f"{kind}{k}", v * (1 + k % 7 / 3.1), 1.0) for k in range(count) for w, v in enumerate(waves[k % 6]) if v]
    both = [(w, "B", 50.0, 1.0) for w in range(1, n + 1)]
    p, c = frame(spark, made("A", 40) + both), frame(spark, made("C", 50) + [(w, "flat", 9.0, 1.0) for w in range(1, n + 1)] + both + [(n + 1, "B", 50.0, 1.0)])
    found = relationships.replacement_candidates(p, c, pairs.build_pair(p, c, C), C)
    got = {(r.source_id, r.target_id): (round(r.correlation, 9), round(r.ratio, 9), r.active_weeks) for r in found.collect()}
    assert got == brute_replacements(p, c, n) and len(got) > 100

    def rows(plan):
        """The most rows that an operator of the plan as it ran gave out."""
        plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan.plan() if plan.nodeName().endswith("QueryStage") else plan
        own = plan.metrics().get("numOutputRows")
        children = plan.children()
        return max([own.get().value() if own.isDefined() else 0, *(rows(children.apply(i)) for i in range(children.size()))])

    assert rows(found._jdf.queryExecution().executedPlan()) < 40 * 50 * 2


def test_erfc(spark):
    import math

    got = spark.range(0, 60).select((F.col("id") / 10).alias("x")).select("x", relationships.erfc(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - math.erfc(r.x)) < 1.3e-7 for r in got)


def entry(**more):
    return {"event_id": "E1", "dataset": C.name, "approved_by": "a", "confirmed": True, "entity_type": "store"} | more


@pytest.mark.parametrize(
    "change,fits",
    [({}, True), ({"confirmed": False}, False), ({"approved_by": None}, False), ({"dataset": "x"}, False), ({"expected_history_end": 5}, False), ({"entity_ids": ["Z"]}, False), ({"classification": lifecycle.REMOVED}, False), ({"expected_history_start": None}, False)],
)
def test_approvals_fit_exactly(spark, change, fits):
    p, c, pair = lives(spark)
    e = entry(classification=lifecycle.NEW_BACKFILL, entity_ids=["B"], expected_history_start=5, expected_history_end=6) | change
    got = attribution.match_approvals(lifecycle.entity_changes(p, c, pair, C), attribution.registry_frame(spark, [e], C), C, 11)
    assert ({r.entity_id: r.approval for r in got.collect()}["B"] == "E1") == fits


def test_closures(spark):
    p, c, pair = lives(spark)
    e = entry(classification=lifecycle.LATEST_MISSING, entity_ids=["F", "A"], effective_from_week=11, effective_to_week=12)
    registry = attribution.registry_frame(spark, [e], C)
    got = attribution.match_approvals(lifecycle.entity_changes(p, c, pair, C), registry, C, 11)
    assert {r.entity_id: r.absence_approval for r in got.collect()}["F"] == "E1"
    assert [r.entity_id for r in attribution.standing_closures(c, registry, 11, C).collect()] == ["F"]
    assert attribution.standing_closures(c, registry, 13, C).count() == 0 and attribution.explained_closures(registry, 1, 10).count() == 0


def test_week_revisions(spark):
    p = store(spark, range(1, 11), 100.0)
    c = store(spark, range(1, 12), 100.0).withColumn("dollar", F.when(F.col("week") == 5, 98.0).otherwise(F.col("dollar")))
    cube = cubes.revision_cube(p, c, ["week", "store_id"], C, [11])
    events = lifecycle.entity_changes(p, c, pairs.build_pair(p, c, C), C)
    judged = lambda k: [r.week for r in attribution.week_revisions(cube, events, k, None).where("material").collect()]
    assert judged(C) == [5] and judged(replaced(C, restatement_weeks=6)) == [] and judged(replaced(C, restatement_weeks=5)) == [5]
    back = c.unionByName(store(spark, (3, 4), 50.0, "N"))
    pair = pairs.build_pair(p, back, C)
    e = lifecycle.entity_changes(p, back, pair, C)
    got = {r.week: r for r in attribution.week_revisions(cubes.revision_cube(p, back, ["week", "store_id"], C, [11]), e, C, "store").collect()}
    assert got[3].explained == 50.0 and got[3].unexplained == 0.0 and not got[3].material


def test_counterfactual_scores(spark):
    p = store(spark, (1, 2), 10.0)
    c = p.unionByName(store(spark, (1, 2), 5.0, "S9")).unionByName(store(spark, (3,)))
    pair = pairs.build_pair(p, c, C)
    events = lifecycle.entity_changes(p, c, pair, C)
    whole = checks.counterfactual(p, c, events, C).first()
    assert (whole.score, whole.raw_delta, whole.explained_delta) == (1.0, 10.0, 10.0)
    half = c.withColumn("dollar", F.when((F.col("store_id") == "S1") & (F.col("week") == 1), 5.0).otherwise(F.col("dollar")))
    assert checks.counterfactual(p, half, events, C).first().score == 0.75
    wrong = events.withColumn("entity_id", F.lit("S1"))
    assert checks.counterfactual(p, c, wrong, C).first().score == 0.0


def test_mass_balance_counts_and_markers(spark):
    base = store(spark, (1, 2), ids="A B")
    same = base.groupBy("week").agg(F.sum("dollar").alias("dollar"), F.sum("units").alias("units"))
    status, found, _ = checks.reconcile(base, same, C)
    assert status == "PASS" and {c.name: c.status for c in found}["mass_balance:dollar"] == "PASS"
    swapped = same.withColumn("dollar", F.when(F.col("week") == 1, F.col("dollar") + 1).otherwise(F.col("dollar") - 1))
    assert checks.reconcile(base, swapped, C)[0] == "RECONCILIATION_FAILURE"
    assert checks.reconcile(base, None, C)[0] == "NOT_EVALUATED"
    k = replaced(C, count_entity_map=(("store_count", "store_id"),))
    assert checks.count_mismatches(base, same.withColumn("store_count", F.lit(2)), "store_count", "store_id", k).first()[0] == 0
    assert checks.count_mismatches(base, same.withColumn("store_count", F.lit(3)), "store_count", "store_id", k).first()[0] == 2
    assert {r.column: r.marker_rows for r in checks.marker_rows(base.unionByName(store(spark, (1,), ids="Total")), C).collect()} == {"store_id": 1}


def test_prices(spark):
    rows = [(w, "A", 100.0 + w % 3, 10.0) for w in range(1, 30)]
    c = frame(spark, rows + [(30, "A", 300.0, 10.0)])
    assert [r.week for r in checks.price_outliers(c, C, [30]).collect()] == [30]
    assert checks.price_outliers(frame(spark, rows + [(30, "A", 101.0, 10.0)]), C, [30]).count() == 0
    assert checks.price_outliers(frame(spark, rows[:4] + [(5, "A", 900.0, 1.0)]), C, [5]).count() == 0
    assert checks.price_outliers(frame(spark, [(w, "A", 10.0, 1.0) for w in range(1, 30)] + [(30, "A", 99.0, 1.0)]), C, [30]).count() == 0


def test_hierarchy(spark):
    df = store(spark, (1, 2), ids="A B C")
    assert all(c.status == "PASS" for c in checks.hierarchy_checks(df, C))
    holed = df.withColumn("store_id", F.when(F.col("store_id") != "B", F.col("store_id")))
    assert "hierarchy_keys:store_id" in {c.name for c in checks.hierarchy_checks(holed, C) if c.status == "FAIL"}
    rows = {(r.level, r.week, r.store_id): r.dollar for r in checks.hierarchy(df, C).collect()}
    assert rows["national", 1, None] == 30.0 and rows["store_id", 2, "B"] == 10.0 and len(rows) == 8


def test_lineage_finds_the_stage(spark):
    p = store(spark, (1, 2))
    c = store(spark, (1, 2, 3))
    bent = c.withColumn("dollar", F.when(F.col("week") == 2, 5.0).otherwise(F.col("dollar")))
    pair = pairs.build_pair(p, c, C)
    assert checks.lineage([("source", p, c), ("coded", p, c)], pair, C)["status"] == "PASS"
    assert checks.lineage([("source", p, c), ("coded", p, bent), ("warehouse", p, bent)], pair, C)["first_divergence"] == "coded"
    assert checks.lineage([("other", p, c)], pair, C)["status"] == "UNKNOWN"


def test_reference(spark):
    df = store(spark, (1, 2))
    spec = checks.ReferenceSpec("R", C.name, ("dollar",))
    assert checks.compare_reference(df, df, spec, C)["status"] == "MATCH"
    off = df.withColumn("dollar", F.col("dollar") * 1.01)
    got = checks.compare_reference(df, off, spec, C)
    assert got["status"] == "MISMATCH" and checks.reference_mismatches(got) == ["dollar"]
    assert checks.compare_reference(df, df.where("week = 1"), spec, C)["status"] == "INCOMPLETE"
    assert checks.compare_reference(df, df, checks.ReferenceSpec("R", "x", ("dollar",)), C)["status"] == "INCOMPLETE"
    with pytest.raises(ValueError):
        checks.ReferenceSpec("", "x", ())


def test_fingerprints_ignore_order(spark):
    df = store(spark, (1, 2), ids="A B")
    assert fingerprints.frame_digest(df) == fingerprints.frame_digest(df.orderBy(F.desc("week")).repartition(3))
    assert fingerprints.frame_digest(df) != fingerprints.frame_digest(df.withColumn("dollar", F.col("dollar") + 1))
    a, b = (fingerprints.fingerprint(x, C).first().asDict() for x in (df, df.unionByName(store(spark, (1,), 5.0, "N"))))
    d = fingerprints.fingerprint_deltas(a, b)
    assert (d["rows"], d["sum_dollar"], d["distinct_store_id"], d["entity_hash"]) == (1.0, 5.0, 1.0, 1.0)


def test_adjusted_p_values(spark):
    from snapwarden.functions.stats import benjamini_hochberg

    p = [0.001, 0.4, 0.6, 0.02, 0.02, 0.9, 0.0, 1.0, 1e-300, 1.0]
    df = spark.createDataFrame([*enumerate(p), (99, None)], "i int, p_value double")
    got = {r.i: (r.adjusted_p, r.significant) for r in relationships.benjamini_hochberg(df, 0.05).collect()}
    assert got.pop(99) == (None, False)
    want = benjamini_hochberg(p, 0.05)
    assert len(got) == len(p) and all(got[i] == (pytest.approx(want[0][i]), want[1][i]) for i in got)
    by = df.withColumn("half", F.col("i") % 2)
    got = {r.i: r.adjusted_p for r in relationships.benjamini_hochberg(by, 0.05, keys=["half"]).collect()}
    for k in (0, 1):
        own = benjamini_hochberg(p[k::2], 0.05)[0]
        assert [got[i] for i in range(k, len(p), 2)] == pytest.approx(own)
    assert benjamini_hochberg([0.001, 0.4, 0.6], 0.05)[1] == [True, False, False]
