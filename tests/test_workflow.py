"""Sources, approvals, whole assessments, the journal, and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig, replaced
from snapwarden.evaluate import harness, scores
from snapwarden.operators.lifecycle import NEW_BACKFILL
from snapwarden.plans import approvals, assess, journal, notify, onboard, policy, report
from snapwarden.sources import versions
from snapwarden.world import faults

FAMILIES = ["clean", "warehouse_transform_error", "schema_failure"]


@pytest.fixture(scope="module")
def shadow(spark):
    return harness.run_shadow(spark, FAMILIES, "tiny", (7,))


def test_families_end_as_expected(shadow):
    assert {r["family"]: r["status"] for r in shadow["records"]} == {r["family"]: r["expected"] for r in shadow["records"]}
    assert shadow["metrics"]["detection"]["rate"] == 1.0 and shadow["metrics"]["false_positive"]["rate"] == 0.0


def test_origins_are_found(shadow):
    got = {r["family"]: r["first_divergence"] for r in shadow["records"]}
    assert got["warehouse_transform_error"] == "warehouse"


@pytest.mark.parametrize("family", ["commodity_remap"])
def test_generator_checks_itself(spark, family):
    assert all(faults.verify(faults.build(spark, family, "tiny")).values())


def test_generator_is_deterministic(spark):
    from snapwarden.operators.fingerprints import frame_digest

    a, b = (faults.build(spark, "clean", "tiny", 3).facts["V0002"]["report"] for _ in range(2))
    assert frame_digest(a) == frame_digest(b.repartition(3))


def rows(spark, weeks, dollar=100.0):
    return spark.createDataFrame([(w, s, dollar + w % 4, 10.0) for w in range(1, weeks + 1) for s in ("A", "B")], "week int, store_id string, dollar double, units double")


PLAIN = replaced(DatasetConfig(), name="plain", metric_columns=("dollar", "units"), snapshot_metrics=(), entity_columns=("store_id",), entity_key_columns=("store_id",), report_grain=(), analysis_stage="fact", contract_stage="fact", stage_keys=(("fact", ("store_id",)),), count_entity_map=(), hierarchy_columns=(), hierarchy_intersections=(), temporal_entity_columns=("store_id",), pipeline_order=("fact",))


@pytest.fixture(scope="module")
def manifest(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("snapshots")
    snapshots = []
    for k, n in enumerate((59, 60)):
        rows(spark, n).write.parquet(f"file://{folder}/v{k}")
        snapshots.append({"version": f"v{k}", "observed_at": f"2024-01-0{k + 1}T00:00:00", "stages": {"fact": f"v{k}"}, "dimensions": {}})
    (folder / "manifest.json").write_text(json.dumps({"schema_version": 1, "source_id": "test", "snapshots": snapshots}))
    return f"file://{folder}/manifest.json"


def test_manifest_source(spark, manifest, tmp_path):
    s = versions.ParquetManifestSource(spark, manifest)
    assert s.list_versions() == ["v0", "v1"] and s.available_stages("v1") == ["fact"] and s.read_fact_columns("v1", "fact", ["week", "nope"]).columns == ["week"]
    assert s.snapshot_metadata("v1")["committed_ms"] > s.snapshot_metadata("v0")["committed_ms"]
    said = json.loads(versions.read_text(spark, manifest))
    for change in (lambda m: m["snapshots"][0]["stages"].update(fact="../x"), lambda m: m["snapshots"].reverse(), lambda m: m.update(schema_version=2)):
        bad = json.loads(json.dumps(said))
        change(bad)
        (tmp_path / "m.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            versions.ParquetManifestSource(spark, f"file://{tmp_path}/m.json").read_fact(bad["snapshots"][0]["version"], "fact")


def test_renaming_and_calendars(spark):
    base = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-08", 2.0)], "wk string, dollar double")
    src = versions.FrameSource({"v": {"fact": base}})
    c = replaced(PLAIN, column_map=(("week", "wk"),), calendar="weekly_date")
    got = versions.CachedSource(versions.mapped(src, c), c).read_fact("v", "fact")
    weeks = sorted(r.week for r in got.collect())
    assert weeks[1] - weeks[0] == 1
    with pytest.raises(ValueError):
        versions.normalise_weeks(spark.createDataFrame([("2024-01-01",), ("2024-01-09",)], "week string"), c)
    m = replaced(PLAIN, calendar="mapped", period_map=(("2024W1", 1), ("2024W2", 2)))
    assert sorted(r.week for r in versions.normalise_weeks(spark.createDataFrame([("2024W2",), ("2024W1",)], "week string"), m).collect()) == [1, 2]
    with pytest.raises(ValueError):
        versions.MappedSource(versions.FrameSource({"v": {"fact": base.withColumn("week", F.lit(1))}}), {"wk": "week"}).read_fact("v", "fact")


def test_wide_feed_and_checked_join(spark):
    wide = spark.createDataFrame([("a", 1.0, 0.0, 3.0), ("b", 0.0, 0.0, 0.0)], "item string, d1 double, d2 double, d3 double")
    calendar = spark.createDataFrame([("d1", 1), ("d2", 1), ("d3", 2)], "day string, week int")
    assert sorted(map(tuple, versions.weekly_long(wide, ["d1", "d2", "d3"], ["item"], calendar).collect())) == [(1, "a", 1.0), (2, "a", 3.0)]
    with pytest.raises(ValueError):
        versions.checked_left_join(wide, wide.unionByName(wide).select("item"), ["item"])


def test_weekly_run_is_idempotent(spark, manifest, tmp_path):
    source = versions.ParquetManifestSource(spark, manifest)
    first = journal.run_weekly(source, PLAIN, str(tmp_path / "j.db"), str(tmp_path / "out"))
    again = journal.run_weekly(source, PLAIN, str(tmp_path / "j.db"), str(tmp_path / "out"))
    assert first.status == "PASS" and first.exit_code == 0 and not first.reused and again.reused and again.assessment_id == first.assessment_id
    assert sorted(os.listdir(first.folder)) == ["report.json", "report.md"]
    machine = json.load(open(f"{first.folder}/report.json"))
    assert machine["status"] == "PASS" and report.markdown(machine).startswith("# plain: PASS")
    j = journal.Journal(str(tmp_path / "j.db"))
    assert len(j.runs("plain")) == 1 and j.latest("plain")["assessment_id"] == first.assessment_id
    with open(tmp_path / "j.db.lock", "w") as held:
        import fcntl

        fcntl.flock(held, fcntl.LOCK_EX)
        with pytest.raises(journal.Busy):
            journal.run_weekly(source, PLAIN, str(tmp_path / "j.db"), str(tmp_path / "out"))


def test_stream_of_manifests(spark, manifest, tmp_path):
    from snapwarden.streaming.refreshes import watch

    folder = os.path.dirname(manifest.removeprefix("file://"))
    done = []
    q = watch(spark, f"file://{folder}", PLAIN, str(tmp_path / "j.db"), str(tmp_path / "out"), f"file://{tmp_path}/state", done.append)
    q.awaitTermination(180)
    assert [d.status for d in done] == ["PASS"]


def test_journal_rolls_back(tmp_path):
    j = journal.Journal(str(tmp_path / "j.db"))
    with pytest.raises(RuntimeError), j.transaction():
        j.begin("x")
        raise RuntimeError
    assert j.db.execute("SELECT count(*) FROM attempts").fetchone()[0] == 0
    with pytest.raises(ValueError):
        journal.publish(str(tmp_path / "out"), {"a": "1"}, {"a": "0"})


def test_cutoff_and_missing_stage(spark, manifest):
    source = versions.ParquetManifestSource(spark, manifest)
    with pytest.raises(ValueError):
        assess.assess(source, PLAIN, observed_at="2024-01-01T12:00:00+00:00")
    other = assess.assess(source, replaced(PLAIN, analysis_stage="gone"), with_manifest=False)  # the next stage that both versions have is read
    assert other.status == "PASS" and other.machine["stages"]["analysis"] == "fact"
    apart = versions.FrameSource({"a": {"fact": rows(spark, 59)}, "b": {"raw": rows(spark, 60)}}, {})
    assert assess.assess(apart, PLAIN, with_manifest=False).status == "INCOMPLETE"


def test_status_precedence():
    f = policy.Finding
    worse = [f("a", "s", "PASS"), f("a", "s", "FAIL", approval_ids=("x",)), f("a", "s", "UNAVAILABLE"), f("a", "s", "FAIL"), f("a", "s", "CONTRACT_FAILURE")]
    assert [policy.status_of(worse[: k + 1]) for k in range(5)] == list(policy.STATUSES)
    assert policy.status_of([f("a", "s", "UNAVAILABLE", required=False), f("a", "s", "SKIPPED")]) == "PASS"
    assert policy.status_of(policy.with_options([f("t", "s", "UNAVAILABLE"), f("contracts:x", "s", "PASS")], ("t",))) == "PASS"
    with pytest.raises(ValueError):
        f("a", "s", "MAYBE")
    assert f("a", "s", "FAIL").finding_id == f("a", "s", "PASS").finding_id != f("a", "t", "FAIL").finding_id


def test_expectations():
    e = approvals.RatioExpectation("E", "d", "dollar_per_unit", 1.0, 2.0, effective_from="2024-01-01", effective_to="2024-12-31", approved_by="a", approved_at="2024-01-02T00:00:00+00:00")
    flag = {"metric": "dollar_per_unit", "week": 5, "ratio": 1.5}
    assert approvals.apply_expectations([flag], [e, e], "d", "2024-05-01")["expected"][0]["ambiguous"]
    for change, dataset, when in (({"ratio": 3.0}, "d", "2024-05-01"), ({}, "x", "2024-05-01"), ({}, "d", "2025-05-01"), ({}, "d", "2024-01-01T00:00:00+00:00"), ({"metric": "y"}, "d", "2024-05-01"), ({}, "d", "7")):
        assert approvals.apply_expectations([flag | change], [e], dataset, when)["unexpected"]
    for bad in ({}, {"min_ratio": 2.0, "max_ratio": 1.0}, {"min_ratio": float("nan")}, {"min_ratio": 1.0, "effective_from": "2024-01-01", "effective_to": "5"}):
        with pytest.raises(ValueError):
            approvals.RatioExpectation("E", "d", "m", **bad)


def test_notices():
    found = [approvals.Candidate("c0", NEW_BACKFILL, "store", ["S900"], [1, 2, 3], []), approvals.Candidate("c1", "LATEST_WEEK_MISSING", "store", ["S001"], [9], [])]
    texts = ["[d] New store S900 joins the panel, weeks 1-3 loaded", "[other] store S900 joins the panel", "store S001 closed for refit", "store S001 will be closed", "hello"]
    got = approvals.draft(found, [{"id": str(k), "text": t} for k, t in enumerate(texts)], approvals.PatternMatcher(), "d", 9)
    assert [m["candidate"]["key"] if m["candidate"] else None for m in got["matches"]] == ["c0", None, "c1", None, None]
    assert [d["confirmed"] for d in got["registry_drafts"]] == [False, False] and got["registry_drafts"][1]["effective_from_week"] == 9


def test_notifications(tmp_path):
    machine = {"dataset": "d", "run_id": "r", "status": "INVESTIGATE", "previous": "a", "current": "b", "findings": [{"disposition": "HARD_FAILURE", "check": "c" * 50, "scope": "s", "metric": "", "period": None, "impact": 0.0}] * 500}
    assert len(notify.payload(machine, 4000)) <= 4000
    sinks = [notify.Sink("file", str(tmp_path / "n.jsonl")), notify.Sink("stdout", statuses=("PASS",)), notify.Sink("file", "/proc/none/x")]
    assert [r["outcome"].split(":")[0] for r in notify.send_all(sinks, machine)] == ["sent", "filtered", "failed"]
    for url in ("http://a.example", "https://127.0.0.1/x", "https://u:p@a.example", "https://localhost/x"):
        with pytest.raises(ValueError):
            notify.Sink("webhook", url)


def test_markdown_is_escaped():
    assert report.cell("a|b\n*c*") == "a\\|b \\*c\\*"


def test_onboarding(spark):
    found = onboard.profile(rows(spark, 30))
    assert (found["week_column"], found["entity_columns"], found["metric_columns"]) == ("week", ["store_id"], ["dollar", "units"])
    c = onboard.proposed_config(onboard.propose(found, "mine"))
    assert c.primary_metric == "dollar" and c.entity_key_columns == ("store_id",)
    with pytest.raises(ValueError):
        onboard.propose(onboard.profile(spark.createDataFrame([("x",)], "a string")), "mine")


def test_evaluation_scores(spark):
    cases = [scores.EvaluationCase(str(k), str(k % 3), k < 6, k < 5 or k == 8, 1, "X", "X" if k else "Y") for k in range(10)]
    m = scores.metrics(cases)
    assert (m["detection"]["hits"], m["detection"]["n"], m["false_positive"]["hits"], m["missed"]) == (5, 6, 1, ["5"])
    assert not scores.gates(cases, 0.9, 0.1)["detection"] and not scores.gates([], 0.0, 1.0)["detection"]
    got = scores.metrics_frame(spark.createDataFrame(cases)).first()
    assert (got.actionable, got.detected, got.controls, got.false_alarms) == (6, 5, 4, 1)
    assert scores.mcnemar([True] * 10, [False] * 10) == pytest.approx(2 / 1024) and scores.nearest_rank([3, 1, 2], 0.5) == 2
    assert scores.false_clearance_bound([scores.EvaluationCase("a", "a", True, True)] * 58) == pytest.approx(0.05, abs=0.002)


def test_command_line(capsys):
    from snapwarden import cli

    assert cli.main(["list-faults"]) == 0 and "missing_stores" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run"])
