"""Structural fingerprints and digests of frames. Rows have no order in Spark, so digests are those of multisets."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig
from snapwarden.operators.contracts import facts
from snapwarden.operators.cubes import measures


def digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str, allow_nan=False).encode()).hexdigest()


def frame_digest(df: DataFrame) -> str:
    """Column names and types, row count, and two order-free sums of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return digest([sorted(df.dtypes), r.n, r.x, str(r.s)])


def entity_set_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of distinct entity tuples and an order-free hash of the set, from 60 bits of each tuple's MD5."""
    whole = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])
    h = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")
    return df.select(*columns).distinct().select(h.alias("h")).agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("entity_hash"))


def fingerprint(df: DataFrame, config: DatasetConfig, keys: list[str] | None = None) -> DataFrame:
    """One row: rows, weeks, nulls, duplicate keys, measure sums, distinct entities and the hash of the entity set."""
    keys = keys if keys is not None else [k for k in (config.week_column, *config.entity_key_columns) if k in df.columns]
    entities = [c for c in config.entity_columns if c in df.columns]
    names = measures(df, config)
    base = facts(df, keys, names, config.week_column).select("rows", "weeks", "nulls", "duplicates")
    sums = df.agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(f"sum_{m}") for m in names], *[F.count_distinct(c).alias(f"distinct_{c}") for c in entities])
    own = [c for c in keys if c != config.week_column] or entities
    return base.crossJoin(sums).crossJoin(entity_set_hash(df, own) if own else df.sparkSession.createDataFrame([(0, 0)], "entities long, entity_hash long"))


def fingerprint_deltas(previous: dict[str, Any], current: dict[str, Any]) -> dict[str, float]:
    """Differences of the shared numbers; for the hash 1 where it changed."""
    out = {}
    for k in sorted(set(previous) & set(current)):
        a, b = previous[k], current[k]
        out[k] = float(a != b) if k == "entity_hash" else float((b or 0) - (a or 0))
    return out


def manifest_id(manifest: dict[str, Any]) -> str:
    return digest({k: manifest[k] for k in sorted(manifest) if k not in ("created_at",)})
