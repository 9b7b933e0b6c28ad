"""The truth of generated scenarios, kept apart from what an assessment may read, and the check of a suite against it."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from snapwarden.functions.jsonutil import dumps
from snapwarden.operators.fingerprints import frame_digest
from snapwarden.sources.versions import write_version
from snapwarden.world.faults import Scenario, verify


class Vault:
    """A folder of its own with one file of truth for each scenario; nothing of it lies in the scenario's folder."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def put(self, name: str, truth: dict[str, Any]) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / f"{name}.json").write_text(dumps(truth, indent=1), encoding="utf-8")

    def get(self, name: str) -> dict[str, Any]:
        return json.loads((self.folder / f"{name}.json").read_text(encoding="utf-8"))

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))


def write_scenario(s: Scenario, folder: str, vault: Vault, name: str) -> None:
    """The scenario's versions under its folder; family, affected entities, expected status and digests in the vault."""
    manifests = {v: write_version(f"{folder}/{name}", v, s.facts[v], s.dims[v]) for v in s.facts}
    vault.put(name, {"family": s.family, "affected": s.case.affected, "weeks": list(s.case.weeks or ()), "status": s.spec.status, "origin": s.spec.origin, "stage": s.spec.stage, "manifests": manifests, "invariants": verify(s)})


def verify_suite(spark: SparkSession, folder: str, vault: Vault) -> dict[str, list[str]]:
    """For each scenario what doesn't hold: a table that is gone or differs from its digest or row count, an invariant of its family."""
    out: dict[str, list[str]] = {}
    for name in vault.names():
        truth, wrong = vault.get(name), []
        wrong += [f"invariant {k}" for k, ok in truth["invariants"].items() if not ok]
        for version, manifest in truth["manifests"].items():
            for kind in ("stages", "dims"):
                for table, said in manifest[kind].items():
                    try:
                        df = spark.read.parquet(f"{folder}/{name}/versions/{version}/" + ("{0}/fact.parquet" if kind == "stages" else "dims/{0}.parquet").format(table))
                        if df.count() != said["rows"] or frame_digest(df) != said["digest"]:
                            wrong.append(f"{version}/{table} differs")
                    except Exception as e:  # a missing folder, or one that isn't Parquet
                        wrong.append(f"{version}/{table} can't be read: {type(e).__name__}")
        out[name] = wrong
    return out
