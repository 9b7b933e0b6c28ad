"""A weekly retail fact derived from the order tables, in two versions with deterministic differences.

The differences follow key arithmetic: stores that lose history, miss the latest week, come under a new id or appear with
history; products whose past is recalculated or whose category changes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapwarden.config import DatasetConfig

LAST_WEEK = 357
#: Stores that are broadcast to the lines.
FEW = 500_000

CONFIG = replace(
    DatasetConfig(), name="retail-weekly", metric_columns=("dollar", "units"), required_columns=("week", "dollar", "units"), snapshot_metrics=(), hierarchy_columns=(("state_id", "banner_id", "store_id"), ("commodity_id", "product_id")),
    hierarchy_intersections=(("state_id", "commodity_id"),), stage_keys=(("warehouse", ("store_id", "product_id")), ("report", ("banner_id", "state_id"))),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, store, product keys and their parents, dollar, units), one row per week, store and product.

    Lines are summed by their keys before the dimensions are joined, so the joins see one row per key. They are dealt out once,
    by product, which serves the sums and the join with products; up to FEW stores are broadcast, more are joined by a shuffle."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) / 7).cast("int") + 1
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity").repartition("l_partkey").groupBy(week.alias("week"), F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("pk")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("dollar"), F.sum("l_quantity").alias("units"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_type").alias("commodity_id"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("state_id"))
    store = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"), "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("sk", F.col("s_nationkey").cast("string").alias("banner_id"), "state_id")
    few = table(spark, sf_dir, "supplier").count() <= FEW
    return lines.join(part, "pk").join(F.broadcast(store) if few else store, "sk").select("week", "sk", "pk", F.col("sk").cast("string").alias("store_id"), F.col("pk").cast("string").alias("product_id"), "commodity_id", "banner_id", "state_id", "dollar", "units")


FACT = ("week", "store_id", "product_id", "commodity_id", "banner_id", "state_id", "dollar", "units")


_written: dict[tuple[str, str], str] = {}


def written_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weekly_fact from a table that a session writes once for each folder of input: what reads both versions, or one of them often, scans it instead of joining the order tables again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            return weekly_fact(spark, sf_dir)
        path = f"{(root or 'file://' + tempfile.gettempdir() + '/snapwarden-facts').rstrip('/')}/weekly-fact-{uuid.uuid4().hex}"
        weekly_fact(spark, sf_dir).write.parquet(path)
        _written[key] = path
        atexit.register(_forget, spark, path)
    return spark.read.parquet(_written[key])


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have ended before
        return


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The previous and the current version."""
    fact, s, p, w = written_fact(spark, sf_dir), F.col("sk"), F.col("pk"), F.col("week")
    previous = fact.where((w < LAST_WEEK) & (s % 50 != 17) & ~((s % 50 == 19) & (w < 100)) & (p % 211 != 9)).select(*FACT)
    scale = F.when((p % 97 == 3) & (w <= 340), 0.9).otherwise(1.0) * F.when(s % 50 == 13, 1.1).otherwise(1.0)
    current = fact.where(~((s % 50 == 7) & (w == LAST_WEEK)) & ~((s % 50 == 11) & (w <= 20)))
    current = current.withColumns({"dollar": F.col("dollar") * scale, "store_id": F.when(s % 50 == 13, F.concat(F.lit("R"), "store_id")).otherwise(F.col("store_id")), "commodity_id": F.when(p % 101 == 5, "RECODED").otherwise(F.col("commodity_id"))})
    return previous, current.select(*FACT)


#: The same in SQL: common table expressions fact, prev and cur.
SQL = """
WITH lines AS (
  SELECT CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) + 1 AS week, l_suppkey AS sk, l_partkey AS pk,
         sum(l_extendedprice * (1 - l_discount)) AS dollar, sum(l_quantity) AS units
  FROM lineitem GROUP BY ALL),
fact AS (
  SELECT week, sk, pk, CAST(sk AS VARCHAR) AS store_id, CAST(pk AS VARCHAR) AS product_id, p_type AS commodity_id, CAST(s_nationkey AS VARCHAR) AS banner_id,
         CAST(n_regionkey AS VARCHAR) AS state_id, dollar, units
  FROM lines JOIN part ON p_partkey = pk JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey),
prev AS (
  SELECT week, store_id, product_id, commodity_id, banner_id, state_id, dollar, units FROM fact
  WHERE week < 357 AND sk % 50 <> 17 AND NOT (sk % 50 = 19 AND week < 100) AND pk % 211 <> 9),
cur AS (
  SELECT week, CASE WHEN sk % 50 = 13 THEN 'R' || store_id ELSE store_id END AS store_id, product_id, CASE WHEN pk % 101 = 5 THEN 'RECODED' ELSE commodity_id END AS commodity_id,
         banner_id, state_id, dollar * (CASE WHEN pk % 97 = 3 AND week <= 340 THEN 0.9 ELSE 1.0 END * CASE WHEN sk % 50 = 13 THEN 1.1 ELSE 1.0 END)::DOUBLE AS dollar, units
  FROM fact WHERE NOT (sk % 50 = 7 AND week = 357) AND NOT (sk % 50 = 11 AND week <= 20))
"""
