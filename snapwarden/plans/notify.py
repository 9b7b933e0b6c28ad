"""Notifications to files, standard output and web hooks."""

from __future__ import annotations

import ipaddress
import json
import os
import sys
import urllib.request
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

from snapwarden.functions.jsonutil import dumps


@dataclass(frozen=True)
class Sink:
    kind: str
    target: str = ""
    statuses: tuple[str, ...] = ()
    timeout: float = 10.0

    def __post_init__(self) -> None:
        if self.kind not in ("webhook", "file", "stdout"):
            raise ValueError(f"unknown sink {self.kind!r}")
        if self.kind == "webhook":
            check_target(self.target)


def check_target(url: str) -> None:
    """Web hooks go over HTTPS to named hosts or public addresses, without credentials in the address."""
    parts = urlsplit(url)
    if parts.scheme != "https" or not parts.hostname or parts.username or parts.password:
        raise ValueError("a web hook needs an https address without credentials")
    try:
        if not ipaddress.ip_address(parts.hostname).is_global:
            raise ValueError("a web hook must not go to a private address")
    except ValueError as e:
        if "private" in str(e):
            raise
    if parts.hostname == "localhost":
        raise ValueError("a web hook must not go to this host")


def load_sinks(path: str) -> list[Sink]:
    with open(path, encoding="utf-8") as f:
        return [Sink(s["kind"], s.get("target", ""), tuple(s.get("statuses", ())), float(s.get("timeout", 10))) for s in json.load(f)["sinks"]]


def payload(machine: Mapping[str, Any], max_bytes: int = 32_000) -> str:
    """What a reader needs at once; the longest list is cut until the text fits."""
    review = [f for f in machine.get("findings", []) if f["disposition"] in ("HARD_FAILURE", "UNEXPLAINED_ANOMALY")]
    said: dict[str, Any] = {"dataset": machine["dataset"], "run_id": machine["run_id"], "status": machine["status"], "previous": machine["previous"], "current": machine["current"], "n_review": len(review), "review": [{k: f[k] for k in ("check", "scope", "metric", "period", "impact")} for f in review], "causes": machine.get("decisions", {}).get("likely_causes", {}).get("value", [])}
    while len(text := dumps(said).encode()) > max_bytes and said["review"]:
        said["review"] = said["review"][: len(said["review"]) // 2]
        said["truncated"] = True
    return text.decode()


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: Any) -> None:
        raise ValueError("a web hook must not redirect")


def send(sink: Sink, text: str) -> str:
    if sink.kind == "stdout":
        print(text, file=sys.stdout, flush=True)
    elif sink.kind == "file":
        os.makedirs(os.path.dirname(os.path.abspath(sink.target)), exist_ok=True)
        with open(sink.target, "a", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        request = urllib.request.Request(sink.target, text.encode(), {"Content-Type": "application/json"}, method="POST")
        with urllib.request.build_opener(_NoRedirect).open(request, timeout=sink.timeout) as answer:
            if answer.status >= 300:
                raise ValueError(f"answered {answer.status}")
    return "sent"


def send_all(sinks: Sequence[Sink], machine: Mapping[str, Any]) -> list[dict[str, str]]:
    """A failing sink doesn't stop the others, nor the run."""
    out, text = [], payload(machine)
    for s in sinks:
        if s.statuses and machine["status"] not in s.statuses:
            out.append({"kind": s.kind, "outcome": "filtered"})
            continue
        try:
            out.append({"kind": s.kind, "outcome": send(s, text)})
        except Exception as e:  # told in the result
            out.append({"kind": s.kind, "outcome": f"failed: {e}"})
    return out
