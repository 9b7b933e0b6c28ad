"""An assessment as strict JSON and as Markdown."""

from __future__ import annotations

import os
from typing import Any

from snapwarden.functions.jsonutil import dumps, sanitise
from snapwarden.plans.assess import Result


def cell(value: Any) -> str:
    """Text that can't break a Markdown table or line."""
    text = "" if value is None else str(value)
    for c in "\\`*_[]<>|":
        text = text.replace(c, f"\\{c}")
    return " ".join(text.split())


def table(head: list[str], rows: list[list[Any]]) -> str:
    line = lambda r: "| " + " | ".join(map(cell, r)) + " |"
    return "\n".join([line(head), "|" + "---|" * len(head), *map(line, rows)])


def number(x: Any) -> str:
    return "–" if x is None else f"{x:,.2f}" if isinstance(x, float) else str(x)


def percent(x: float | None) -> str:
    return "–" if x is None else f"{100 * x:.2f} %"


def machine(result: Result) -> dict[str, Any]:
    return sanitise(result.machine)


def markdown(m: dict[str, Any]) -> str:
    """Summary, likely causes, review list, structure, history, latest period, sensitivity, checks that passed."""
    findings = m.get("findings", [])
    open_ = [f for f in findings if f["disposition"] in ("HARD_FAILURE", "UNEXPLAINED_ANOMALY") or (f["outcome"] == "UNAVAILABLE" and f["required"])]
    parts = [f"# {cell(m['dataset'])}: {m['status']}", f"Compared {cell(m['previous'])} with {cell(m['current'])}. {len(findings)} checks, {len(open_)} to review."]
    if d := m.get("decisions"):
        parts += ["## Likely causes", f"{', '.join(d['likely_causes']['value']) or 'none named'}; origin {d['likely_origin']['value']}; severity {d['severity']['value']}. Probabilities are heuristic."]
    if open_:
        parts += ["## To review", table(["check", "scope", "measure", "period", "outcome", "impact", "detail"], [[f["check"], f["scope"], f["metric"], f["period"], f["outcome"], number(f["impact"]), f["detail"]] for f in open_[:50]])]
    if e := m.get("events"):
        parts += ["## Structure", table(["change", "entities"], sorted(e["counts"].items())) if e["counts"] else "No entity changed."]
    if a := m.get("attribution"):
        h = m["historical_revision"]
        parts += ["## History", f"{h['status']} ({cell(h['reason'])}). Revision {number(a['raw_delta'])} of {number(a['previous_total'])}; gross {number(a['gross_delta'])}; explained {percent(a['explained_fraction'])}; breadth {percent(a['breadth'])}."]
        if a.get("contributors"):
            parts.append(table(["entity", "revision"], [[c["entity_id"], number(c["delta"])] for c in a["contributors"]]))
    if (t := m.get("temporal")) is not None:
        parts += ["## Latest period", f"{t['series']} series, {len(t['anomalies'])} anomalous."]
        if t["anomalies"]:
            parts.append(table(["measure", "series", "period", "actual", "expected", "adjusted p"], [[r["metric"], r["series_id"], r["target"], number(r["actual"]), number(r["point"]), f"{r['adjusted_p']:.2g}"] for r in t["anomalies"][:15]]))
        if t["sensitivity"]:
            parts += ["## Sensitivity", table(["level", "measure", "median change that shows", "least sensitive", "its change"], [[s["level"], s["metric"], percent(s["median_change"]), s["least_sensitive"], percent(s["largest_change"])] for s in t["sensitivity"]])]
    passed = sorted({f["check"] for f in findings if f["outcome"] == "PASS"})
    parts += ["## Passed", ", ".join(map(cell, passed)) or "none"]
    return "\n\n".join(parts) + "\n"


def artifacts(result: Result) -> dict[str, str]:
    m = machine(result)
    return {"report.json": dumps(m, indent=1) + "\n", "report.md": markdown(m)}


def write_report(result: Result, folder: str) -> list[str]:
    """Both files in a folder that must not exist yet."""
    os.makedirs(folder, exist_ok=False)
    out = []
    for name, text in artifacts(result).items():
        out.append(os.path.join(folder, name))
        with open(out[-1], "x", encoding="utf-8") as f:
            f.write(text)
    return out
