"""Addition: the weekly assessment as a stream over a folder of manifests. Nothing is dropped for being late."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from snapwarden.config import DatasetConfig
from snapwarden.plans.journal import Busy, WeeklyResult, run_weekly
from snapwarden.sources.versions import ParquetManifestSource

#: A new manifest is a file; its text is one row.
SCHEMA = "value string"


def manifests(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """One row per manifest that appears: (value, path)."""
    return spark.readStream.schema(SCHEMA).option("wholetext", "true").option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.json").text(folder).selectExpr("value", "_metadata.file_path as path")


def watch(spark: SparkSession, folder: str, config: DatasetConfig, journal: str, out_root: str, checkpoint: str, on_result: Callable[[WeeklyResult], Any] | None = None, available_now: bool = True, **options: Any) -> StreamingQuery:
    """Assess the last two versions of every manifest that appears. A batch that runs again finds its assessment in the journal."""

    def step(batch: DataFrame, _: int) -> None:
        for r in batch.select("path").orderBy("path").collect():  # as many as per_trigger
            try:
                done = run_weekly(ParquetManifestSource(batch.sparkSession, r.path), config, journal, out_root, **options)
            except Busy:
                raise  # the batch is tried again
            if on_result:
                on_result(done)

    writer = manifests(spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
