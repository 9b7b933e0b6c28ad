"""Strict JSON: no NaN, no infinity."""

from __future__ import annotations

import dataclasses
import json
import math
from datetime import date
from typing import Any


def sanitise(value: Any) -> Any:
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return sanitise(dataclasses.asdict(value))
    if hasattr(value, "asDict"):
        return sanitise(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): sanitise(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset | range):
        return [sanitise(v) for v in (sorted(value) if isinstance(value, set | frozenset) else value)]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, date):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def dumps(value: Any, **options: Any) -> str:
    return json.dumps(sanitise(value), sort_keys=True, allow_nan=False, default=str, **options)
