"""Command line: python -m snapwarden.cli <command> --help."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from snapwarden.config import DatasetConfig, load_config
from snapwarden.functions.jsonutil import dumps


def _spark() -> Any:
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("snapwarden").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _source(args: argparse.Namespace) -> Any:
    from snapwarden.sources.versions import DeltaSource, ParquetManifestSource, ScenarioSource

    spark = _spark()
    if args.manifest:
        return ParquetManifestSource(spark, args.manifest)
    if args.delta:
        return DeltaSource(spark, args.delta, args.stage or "warehouse")
    if args.scenario:
        return ScenarioSource(spark, args.scenario)
    raise SystemExit("one of --manifest, --delta and --scenario is needed")


def _config(args: argparse.Namespace) -> DatasetConfig:
    return load_config(args.config) if args.config else DatasetConfig()


def run(args: argparse.Namespace) -> int:
    from snapwarden.plans.approvals import load_expectations
    from snapwarden.plans.assess import assess
    from snapwarden.plans.journal import EXIT
    from snapwarden.plans.report import machine, markdown, write_report

    result = assess(_source(args), _config(args), args.current, args.previous, args.registry, expectations=load_expectations(args.expectations) if args.expectations else ())
    if args.out:
        write_report(result, args.out)
    print(dumps(machine(result), indent=1) if args.json else markdown(machine(result)))
    return EXIT[result.status]


def weekly(args: argparse.Namespace) -> int:
    from snapwarden.plans.approvals import load_expectations
    from snapwarden.plans.journal import BUSY, Busy, run_weekly
    from snapwarden.plans.notify import load_sinks, send_all

    try:
        done = run_weekly(_source(args), _config(args), args.journal, args.out, args.current, args.previous, args.registry, load_expectations(args.expectations) if args.expectations else (), force=args.force)
    except Busy:
        print("another run holds the lock", file=sys.stderr)
        return BUSY
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    sent = send_all(load_sinks(args.notify), done.result.machine) if args.notify and done.result else []
    print(dumps({"assessment_id": done.assessment_id, "status": done.status, "folder": done.folder, "reused": done.reused, "notified": sent}))
    return done.exit_code


def report(args: argparse.Namespace) -> int:
    from snapwarden.plans.report import markdown

    with open(args.machine, encoding="utf-8") as f:
        print(markdown(json.load(f)))
    return 0


def explain(args: argparse.Namespace) -> int:
    from snapwarden.plans.journal import Journal

    journal = Journal(args.journal)
    found = journal.assessment(args.assessment) if args.assessment else journal.latest(args.dataset)
    print(found["artifacts"]["report.md"] if found else "no such assessment")
    return 0 if found else 1


def notices(args: argparse.Namespace) -> int:
    from snapwarden.plans.approvals import PatternMatcher, draft, load_notices, notice_candidates
    from snapwarden.plans.assess import assess

    config, source = _config(args), _source(args)
    result = assess(source, config, args.current, args.previous, args.registry, with_manifest=False)
    found = notice_candidates(result.events, result.replacements, result.pair.current_max_week)
    print(dumps(draft(found, load_notices(args.notices), PatternMatcher(), config.name, result.pair.current_max_week), indent=1))
    return 0


def expectations(args: argparse.Namespace) -> int:
    from snapwarden.plans.approvals import load_expectations

    print(dumps(load_expectations(args.file), indent=1))
    return 0


def onboard(args: argparse.Namespace) -> int:
    from snapwarden.plans.onboard import profile, propose

    found = profile(_spark().read.parquet(args.table), args.sample_rows)
    print(dumps({"profile": found, "proposal": propose(found, args.name) if not any(f["severity"] == "error" for f in found["findings"]) else None}, indent=1))
    return 0


def delta_info(args: argparse.Namespace) -> int:
    from snapwarden.sources.versions import DeltaSource

    print(dumps(DeltaSource(_spark(), args.delta).describe(), indent=1))
    return 0


def generate(args: argparse.Namespace) -> int:
    from snapwarden.plans.approvals import save_registry
    from snapwarden.sources.versions import write_version
    from snapwarden.world.faults import build, verify

    s = build(_spark(), args.family, args.profile, args.seed, args.size)
    for v in s.facts:
        write_version(args.out, v, s.facts[v], s.dims[v])
    if s.case.registry:
        save_registry(s.case.registry, f"{args.out}/registry.json")
    checked = verify(s)
    print(dumps({"family": args.family, "checks": checked}))
    return 0 if all(checked.values()) else 1


def delta_run(args: argparse.Namespace) -> int:
    """The weekly run on a Delta table, whose path comes first."""
    args.manifest = args.scenario = None
    return weekly(args)


def generate_suite(args: argparse.Namespace) -> int:
    from snapwarden.world.faults import build, schedule
    from snapwarden.world.vault import Vault, write_scenario

    for k, family in enumerate(schedule(args.number, args.families)):
        write_scenario(build(_spark(), family, args.profile, args.seed + k), args.out, Vault(args.oracle), f"scenario-{k:03d}")
    return 0


def verify(args: argparse.Namespace) -> int:
    from snapwarden.world.vault import Vault, verify_suite

    found = verify_suite(_spark(), args.suite, Vault(args.oracle))
    print(dumps(found, indent=1))
    return 1 if any(found.values()) or not found else 0


def list_faults(args: argparse.Namespace) -> int:
    from snapwarden.world.faults import SPECS

    print(dumps(SPECS, indent=1))
    return 0


def shadow(args: argparse.Namespace) -> int:
    from snapwarden.evaluate.harness import all_families, run_shadow

    print(dumps(run_shadow(_spark(), args.families or all_families(), args.profile, args.seeds), indent=1))
    return 0


def cohort(args: argparse.Namespace) -> int:
    from snapwarden.evaluate.harness import run_cohort

    with open(args.plan, encoding="utf-8") as f:
        out = run_cohort(_spark(), json.load(f), args.sha256)
    print(dumps(out, indent=1))
    return 0 if all(out["gates"].values()) else 1


def sweep(args: argparse.Namespace) -> int:
    from snapwarden.evaluate.harness import run_sweep, write_results
    from snapwarden.evaluate.scores import sweep_summary, sweep_table

    spark = _spark()
    rows = run_sweep(spark, args.families, args.magnitudes, args.profile, args.seeds)
    if args.out:
        write_results(rows, args.out)
    print(sweep_table([r.asDict() for r in sweep_summary(spark.createDataFrame(rows)).orderBy("family", "magnitude").collect()]))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="snapwarden")
    sub = out.add_subparsers(required=True)

    def command(f: Any, name: str | None = None, versions: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name or f.__name__.replace("_", "-"))
        p.set_defaults(do=f)
        if versions:
            for o in ("--manifest", "--delta", "--scenario", "--stage", "--config", "--current", "--previous", "--registry", "--expectations"):
                p.add_argument(o)
        return p

    p = command(run, versions=True)
    p.add_argument("--out")
    p.add_argument("--json", action="store_true")
    p = command(weekly, versions=True)
    p.add_argument("--journal", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--notify")
    p.add_argument("--force", action="store_true")
    p = command(delta_run)
    p.add_argument("delta")
    for o in ("--stage", "--config", "--current", "--previous", "--registry", "--expectations", "--notify"):
        p.add_argument(o)
    p.add_argument("--journal", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--force", action="store_true")
    p = command(generate_suite)
    p.add_argument("--out", required=True)
    p.add_argument("--oracle", required=True)
    p.add_argument("--number", type=int, default=5)
    p.add_argument("--families", nargs="*")
    p.add_argument("--profile", default="tiny")
    p.add_argument("--seed", type=int, default=7)
    p = command(verify)
    p.add_argument("suite")
    p.add_argument("--oracle", required=True)
    command(report).add_argument("machine")
    p = command(explain)
    p.add_argument("--journal", required=True)
    p.add_argument("--assessment")
    p.add_argument("--dataset", default="")
    command(notices, versions=True).add_argument("notices")
    command(expectations).add_argument("file")
    p = command(onboard)
    p.add_argument("table")
    p.add_argument("--name", required=True)
    p.add_argument("--sample-rows", type=int, default=100_000)
    command(delta_info).add_argument("delta")
    p = command(generate)
    p.add_argument("family")
    p.add_argument("--out", required=True)
    p.add_argument("--profile", default="small")
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--size", type=float)
    command(list_faults)
    for f in (shadow, sweep):
        p = command(f)
        p.add_argument("--families", nargs="*", default=None if f is shadow else ["week_restatement"])
        p.add_argument("--profile", default="tiny")
        p.add_argument("--seeds", nargs="*", type=int, default=[7])
    p.add_argument("--magnitudes", nargs="*", type=float, default=[0.05, 0.2])
    p.add_argument("--out")
    p = command(cohort)
    p.add_argument("plan")
    p.add_argument("--sha256")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.do(args)


if __name__ == "__main__":
    sys.exit(main())
