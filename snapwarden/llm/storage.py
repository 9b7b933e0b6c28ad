"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where it is unset and Spark runs in one JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/snapwarden-shared"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared root, removed by release, or when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


def release(df: DataFrame) -> None:
    """Remove the table that materialise wrote for df, once nothing reads it any more."""
    if path := getattr(df, "_scratch_path", None):
        remove(df.sparkSession, path)


@atexit.register
def _clear() -> None:
    for path, spark in [*_made.items()]:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may have ended before
            return


@contextmanager
def kept_until(spark: SparkSession, earlier: list[str]) -> Iterator[None]:
    """Remove the scratch tables named in ``earlier``, and name there instead those that are made inside."""
    for path in earlier:
        if path in _made:
            remove(spark, path)
    earlier.clear()
    before = set(_made)
    yield
    earlier.extend(p for p in _made if p not in before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """A table (row, doc): every row of docs as a struct, whatever its columns are called, with a number drawn once."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), name)


def arrow_batches(spark: SparkSession, max_bytes: int = 4 << 20) -> None:
    """Bound the bytes of the Arrow batches sent to Python: long texts then make shorter batches. A smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and 0 < int(now) <= max_bytes):
        spark.conf.set(key, str(max_bytes))
