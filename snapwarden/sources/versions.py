"""Where versions of facts come from: manifests of Parquet snapshots, folders, Delta tables, frames; renaming and calendars."""

from __future__ import annotations

import json
import posixpath
import warnings
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig
from snapwarden.functions.calendars import epoch_week
from snapwarden.operators.cubes import clean


class VersionSource(ABC):
    """Ordered versions of a fact table in stages, and its dimensions."""

    @abstractmethod
    def list_versions(self) -> list[str]: ...

    @abstractmethod
    def available_stages(self, version: str) -> list[str]: ...

    @abstractmethod
    def read_fact(self, version: str, stage: str) -> DataFrame: ...

    def read_dim(self, version: str, name: str) -> DataFrame | None:
        return None

    def resolve_stage(self, version: str, preference: Sequence[str] = ()) -> str:
        found = self.available_stages(version)
        if not found:
            raise ValueError(f"version {version!r} has no stage")
        return next((s for s in preference if s in found), sorted(found)[-1])

    def read_fact_columns(self, version: str, stage: str, columns: Sequence[str]) -> DataFrame:
        """Only those of the columns that exist, so that the scan reads no others."""
        df = self.read_fact(version, stage)
        return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])

    def snapshot_metadata(self, version: str) -> dict[str, Any]:
        return {"version": version, "committed_ms": None}


class FrameSource(VersionSource):
    """Frames in memory: {version: {stage: DataFrame}}, and dimensions {version: {name: DataFrame}}."""

    def __init__(self, facts: Mapping[str, Mapping[str, DataFrame]], dims: Mapping[str, Mapping[str, DataFrame]] | None = None):
        self.facts, self.dims = facts, dims or {}

    def list_versions(self) -> list[str]:
        return [*self.facts]

    def available_stages(self, version: str) -> list[str]:
        return [*self.facts[version]]

    def read_fact(self, version: str, stage: str) -> DataFrame:
        return self.facts[version][stage]

    def read_dim(self, version: str, name: str) -> DataFrame | None:
        return self.dims.get(version, {}).get(name)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file from any store that Spark reads."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


class ParquetManifestSource(VersionSource):
    """Snapshots listed in a manifest: {schema_version: 1, source_id, snapshots: [{version, observed_at, stages, dimensions}]}.

    Paths are relative to the manifest and may not leave its folder; observation times must rise."""

    def __init__(self, spark: SparkSession, manifest: str):
        self.spark, self.base = spark, posixpath.dirname(manifest)
        said = json.loads(read_text(spark, manifest))
        if said.get("schema_version") != 1 or not said.get("source_id"):
            raise ValueError("the manifest needs schema_version 1 and a source_id")
        self.source_id, self.snapshots, before = said["source_id"], {}, None
        for s in said.get("snapshots", []):
            at = datetime.fromisoformat(s["observed_at"])
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            if s["version"] in self.snapshots or (before is not None and at <= before):
                raise ValueError("versions must differ and observation times rise")
            self.snapshots[s["version"]] = s | {"at": at}
            before = at

    def _path(self, relative: str) -> str:
        inside = posixpath.normpath(relative)
        if inside.startswith(("/", "..")) or "://" in relative:
            raise ValueError(f"{relative!r} leaves the manifest's folder")
        return f"{self.base}/{inside}"

    def list_versions(self) -> list[str]:
        return [*self.snapshots]

    def available_stages(self, version: str) -> list[str]:
        return [*self.snapshots[version]["stages"]]

    def read_fact(self, version: str, stage: str) -> DataFrame:
        return self.spark.read.parquet(self._path(self.snapshots[version]["stages"][stage]))

    def read_dim(self, version: str, name: str) -> DataFrame | None:
        path = self.snapshots[version].get("dimensions", {}).get(name)
        return self.spark.read.parquet(self._path(path)) if path else None

    def snapshot_metadata(self, version: str) -> dict[str, Any]:
        return {"source_id": self.source_id, "version": version, "committed_ms": int(self.snapshots[version]["at"].timestamp() * 1000)}


class ScenarioSource(VersionSource):
    """Folders versions/<version>/<stage>/fact.parquet and versions/<version>/dims/<name>.parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _list(self, path: str) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()) if system.exists(at) else []

    def list_versions(self) -> list[str]:
        return self._list(f"{self.folder}/versions")

    def available_stages(self, version: str) -> list[str]:
        return [s for s in self._list(f"{self.folder}/versions/{version}") if s != "dims"]

    def read_fact(self, version: str, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/versions/{version}/{stage}/fact.parquet")

    def read_dim(self, version: str, name: str) -> DataFrame | None:
        if f"{name}.parquet" not in self._list(f"{self.folder}/versions/{version}/dims"):
            return None
        return self.spark.read.parquet(f"{self.folder}/versions/{version}/dims/{name}.parquet")


#: Operations that leave a table's rows as they are.
METADATA_ONLY = frozenset({"OPTIMIZE", "VACUUM START", "VACUUM END", "SET TBLPROPERTIES", "UNSET TBLPROPERTIES", "CHANGE COLUMN", "ADD CONSTRAINT", "DROP CONSTRAINT", "REORG", "FSCK", "COMPUTE STATISTICS", "ANALYZE"})


class DeltaSource(VersionSource):
    """Versions of a Delta table, or of one table per stage; needs Delta on the class path.

    In several tables the fact commit's version is mapped to the others by ``version_map``, or by commit time."""

    def __init__(self, spark: SparkSession, uri: str, stage: str = "warehouse", stage_tables: Mapping[str, str] | None = None, dim_tables: Mapping[str, str] | None = None, version_map: Mapping[str, Mapping[str, int]] | None = None, options: Mapping[str, str] | None = None):
        self.spark, self.uri, self.stage = spark, uri, stage
        self.stages, self.dims, self.map, self.options = {stage: uri, **(stage_tables or {})}, dict(dim_tables or {}), version_map or {}, dict(options or {})
        self._logs: dict[str, list[dict[str, Any]]] = {}

    def history(self, uri: str) -> list[dict[str, Any]]:
        """Commits that changed rows, oldest first."""
        if uri not in self._logs:
            rows = self.spark.sql(f"DESCRIBE HISTORY delta.`{uri}`").select("version", "timestamp", "operation").collect()
            self._logs[uri] = sorted(({"version": r.version, "ms": int(r.timestamp.timestamp() * 1000)} for r in rows if r.operation not in METADATA_ONLY), key=lambda r: r["version"])
        return self._logs[uri]

    def list_versions(self) -> list[str]:
        return [str(r["version"]) for r in self.history(self.uri)]

    def _version_of(self, uri: str, name: str, version: str) -> int | None:
        if uri == self.uri:
            return int(version)
        if version in self.map:
            return self.map[version].get(name)
        at = next(r["ms"] for r in self.history(self.uri) if str(r["version"]) == version)
        return max((r["version"] for r in self.history(uri) if r["ms"] <= at), default=None)

    def available_stages(self, version: str) -> list[str]:
        return [s for s, uri in self.stages.items() if self._version_of(uri, s, version) is not None]

    def _read(self, uri: str, name: str, version: str) -> DataFrame | None:
        v = self._version_of(uri, name, version)
        return None if v is None else self.spark.read.format("delta").options(**self.options).option("versionAsOf", v).load(uri)

    def read_fact(self, version: str, stage: str) -> DataFrame:
        df = self._read(self.stages[stage], stage, version)
        if df is None:
            raise ValueError(f"stage {stage!r} has no version for {version!r}")
        return df

    def read_dim(self, version: str, name: str) -> DataFrame | None:
        df = self._read(self.dims[name], name, version) if name in self.dims else None
        if df is None:
            warnings.warn(f"no version of dimension {name!r} for {version!r}", stacklevel=2)
        return df

    def snapshot_metadata(self, version: str) -> dict[str, Any]:
        return {"source_id": self.uri, "version": version, "committed_ms": next(r["ms"] for r in self.history(self.uri) if str(r["version"]) == version)}

    def describe(self) -> dict[str, Any]:
        detail = self.spark.sql(f"DESCRIBE DETAIL delta.`{self.uri}`").first().asDict()
        df = self.spark.read.format("delta").load(self.uri)
        return {"uri": self.uri, "versions": self.list_versions(), "schema": dict(df.dtypes), "partitions": detail.get("partitionColumns"), "rows": df.count()}


class MappedSource(VersionSource):
    """Another source with production names turned into canonical ones."""

    def __init__(self, inner: VersionSource, rename: Mapping[str, str]):
        self.inner, self.rename = inner, dict(rename)
        self._warned: set[str] = set()

    def _apply(self, df: DataFrame) -> DataFrame:
        after = [self.rename.get(c, c) for c in df.columns]
        if clash := sorted({c for c in after if after.count(c) > 1}):
            raise ValueError(f"renaming makes columns collide: {clash}")
        for c in sorted(set(self.rename) - set(df.columns) - self._warned):
            self._warned.add(c)
            warnings.warn(f"mapped column {c!r} is missing", stacklevel=3)
        return df.withColumnsRenamed({k: v for k, v in self.rename.items() if k in df.columns})

    def list_versions(self) -> list[str]:
        return self.inner.list_versions()

    def available_stages(self, version: str) -> list[str]:
        return self.inner.available_stages(version)

    def read_fact(self, version: str, stage: str) -> DataFrame:
        return self._apply(self.inner.read_fact(version, stage))

    def read_dim(self, version: str, name: str) -> DataFrame | None:
        df = self.inner.read_dim(version, name)
        return df if df is None else self._apply(df)

    def snapshot_metadata(self, version: str) -> dict[str, Any]:
        return self.inner.snapshot_metadata(version)


def mapped(source: VersionSource, config: DatasetConfig) -> VersionSource:
    return MappedSource(source, config.source_rename) if config.column_map else source


def normalise_weeks(df: DataFrame, config: DatasetConfig) -> DataFrame:
    """The week column as an integer, under any calendar."""
    week = config.week_column
    if week not in df.columns or config.calendar == "sequential_week":
        return df
    if config.calendar == "mapped":
        if not config.period_map:
            raise ValueError("a mapped calendar needs a period map")
        table = F.create_map(*[F.lit(x) for k, v in config.period_map for x in (str(k), int(v))])
        return df.withColumn(week, F.try_element_at(table, F.col(week).cast("string")))
    day = F.col(week).cast("timestamp")
    seen = df.agg(F.count_distinct(F.dayofweek(day)).alias("days"), F.count_if(day != F.date_trunc("day", day)).alias("times")).first()
    if seen.days > 1 or seen.times:
        raise ValueError("weekly dates must fall on one weekday at midnight")
    return df.withColumn(week, epoch_week(day))


class CachedSource(VersionSource):
    """Every snapshot cleaned, reduced to the configured columns and kept for the time of one assessment."""

    def __init__(self, inner: VersionSource, config: DatasetConfig):
        self.inner, self.config, self.read_count = inner, config, 0
        self._facts: dict[tuple[str, str], DataFrame] = {}
        self._dims: dict[tuple[str, str], DataFrame | None] = {}

    def wanted(self) -> list[str]:
        c = self.config
        return [c.week_column, *c.entity_columns, *c.metric_columns, *[n for n, _ in c.count_entity_map], *c.required_columns, *c.entity_key_columns, *c.report_grain, *[k for _, keys in c.stage_keys for k in keys]]

    def list_versions(self) -> list[str]:
        return self.inner.list_versions()

    def available_stages(self, version: str) -> list[str]:
        return self.inner.available_stages(version)

    def read_fact(self, version: str, stage: str) -> DataFrame:
        key = version, stage
        if key not in self._facts:
            self.read_count += 1
            df = normalise_weeks(self.inner.read_fact_columns(version, stage, self.wanted()), self.config)
            self._facts[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self._facts[key]

    def typed(self, version: str, stage: str) -> DataFrame:
        """The fact with measures as doubles; contracts see it untouched through read_fact."""
        return clean(self.read_fact(version, stage), self.config)

    def read_dim(self, version: str, name: str) -> DataFrame | None:
        key = version, name
        if key not in self._dims:
            self._dims[key] = self.inner.read_dim(version, name)
        return self._dims[key]

    def snapshot_metadata(self, version: str) -> dict[str, Any]:
        return self.inner.snapshot_metadata(version)

    def release(self) -> None:
        for df in self._facts.values():
            df.unpersist()


def write_version(folder: str, version: str, stages: Mapping[str, DataFrame], dims: Mapping[str, DataFrame]) -> dict[str, Any]:
    """Write one version and return its manifest: row counts and digests of all frames."""
    from snapwarden.operators.fingerprints import frame_digest

    out: dict[str, Any] = {"version": version, "stages": {}, "dims": {}}
    for kind, frames, at in (("stages", stages, "{0}/fact.parquet"), ("dims", dims, "dims/{0}.parquet")):
        for name, df in frames.items():
            path = f"{folder}/versions/{version}/{at.format(name)}"
            df.write.mode("overwrite").parquet(path)
            back = df.sparkSession.read.parquet(path)
            out[kind][name] = {"path": path, "rows": back.count(), "digest": frame_digest(back)}
    return out


def weekly_long(wide: DataFrame, days: Sequence[str], keys: Sequence[str], calendar: DataFrame, value: str = "units") -> DataFrame:
    """A feed with one column per day → week × keys sums without zeros. calendar: (day, week), one row per day, broadcast."""
    long = wide.unpivot([F.col(k) for k in keys], [F.col(d) for d in days], "day", value)
    return long.join(F.broadcast(calendar), "day").groupBy("week", *keys).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def weekly_sales(sales: DataFrame, products: DataFrame, stores: DataFrame, first_day: str, *, day: str, store: str, product: str, value: str) -> DataFrame:
    """A daily feed → week, store, product and their parents, units: sums without zeros, whole weeks from ``first_day`` on.

    products: (product, commodity_id), stores: (store, state_id), each key once. Row groups are summed where they are read and
    again after the shuffle. A sold row without a parent is an error."""
    week = F.floor(F.datediff(F.col(day).cast("date"), F.lit(first_day).cast("date")) / 7).cast("int") + 1
    sums = sales.select(week.alias("week"), F.col(store).alias("store"), F.col(product).alias("product"), F.col(value).alias("v")).where("week >= 1").groupBy("week", "store", "product").agg(F.sum("v").cast("double").alias("units")).where("units <> 0")
    joined = checked_left_join(checked_left_join(sums, products, ["product"]), stores, ["store"])
    if joined.where("commodity_id is null or state_id is null").limit(1).count():
        raise ValueError("sold rows without a product group or a state")
    return joined.select("week", F.concat(F.lit("S"), F.col("store").cast("string")).alias("store_id"), F.col("state_id").cast("string").alias("state_id"), F.col("commodity_id").cast("string").alias("commodity_id"), F.concat(F.lit("I"), F.col("product").cast("string")).alias("product_id"), "units")


def checked_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join that refuses repeated keys on the right."""
    if right.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"keys {list(keys)} repeat on the right side")
    return left.join(right, list(keys), "left")
