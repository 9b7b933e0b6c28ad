"""Exact deduplication with a log-structured merge index of text digests, in DataFrame operations only.

Memtables are the input partitions: each flushes one run, a Parquet file sorted by digest with min/max statistics and a
Bloom filter on the digest, which lookups of single digests read. Compaction merges the runs since the last one into the
level, keeping for each digest the smallest identifier and the number of entries. The level's filter, a bitmap made from
the digests that occur more than once and sized by their number, stands in front of it: only texts that pass it are read
again, looked up, and compared byte for byte with the text that stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapwarden.llm.storage import materialise, remove, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The filter is cut into buckets of 32,768 bits (4 KB), at least 1 MB and at most 32 MB in all, as it is broadcast. A full
#: filter only lets more texts through to the join; it never loses one.
BUCKET_BITS, LEAST_BUCKETS, MOST_BUCKETS, BITS_PER_DIGEST = 32768, 256, 8192, 16


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class DigestIndex:
    """Sorted runs of (digest, id) and a level of (digest, keep_id, n) under one shared folder. ``keep``: "min" or "max"."""

    def __init__(self, spark, name: str = "lsm", keep: str = "min"):
        self.spark, self.path, self.best = spark, scratch(spark, name), {"min": F.min, "max": F.max}[keep]
        self.runs: list[str] = []
        self.merged = 0
        self.level_path: str | None = None

    def flush(self, entries: DataFrame) -> None:
        """One sorted run for each partition of entries (digest binary, id); may be called again with more rows."""
        path = f"{self.path}/run-{len(self.runs)}"
        self._write(entries, path)
        self.runs.append(path)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.max.bytes", str(1 << 18)).parquet(path)

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(*self.runs)

    def compact(self) -> DataFrame:
        """Merge the runs since the last compaction into the level: the smallest (or largest) id of each digest, nulls last, and its number of entries. Partial results come before the shuffle."""
        new = self.runs[self.merged :]
        if new:
            parts = self.spark.read.parquet(*new).select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
            if self.level_path:
                parts = parts.unionByName(self.spark.read.parquet(self.level_path))
            old, self.level_path = self.level_path, f"{self.path}/level-{len(self.runs)}"
            self._write(parts.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("n").alias("n")), self.level_path)
            self.merged = len(self.runs)
            if old:
                remove(self.spark, old)
        return self.spark.read.parquet(self.level_path)

    def find(self, digests: Sequence[bytes]) -> DataFrame:
        """The level's rows of some digests: min/max statistics and Bloom filters skip the row groups that can't hold them."""
        return self.spark.read.parquet(self.level_path).where(F.col("digest").isin([bytearray(d) for d in digests]))


def _front(hashed: DataFrame, level: DataFrame) -> DataFrame:
    """The rows of hashed whose digest may occur more than once."""
    often = level.where("n > 1")
    wanted = often.count() * BITS_PER_DIGEST // BUCKET_BITS
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << wanted.bit_length()))
    bit = F.pmod(F.xxhash64("digest"), F.lit(buckets * BUCKET_BITS).cast("long"))
    bitmap = often.select(bit.alias("p")).groupBy(F.expr(f"p div {BUCKET_BITS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(p % {BUCKET_BITS})").alias("bits"))
    tried = hashed.withColumn("p", bit).withColumn("bucket", F.expr(f"p div {BUCKET_BITS}")).join(F.broadcast(bitmap), "bucket")
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast((p % {BUCKET_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return tried.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(p % 8 as int))")) != 0).select("digest", "id", "body")


def exact_dedup(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keep: str = "min") -> DataFrame:
    """Group rows with equal texts (A-Z in lower case, null as empty) and keep one row of each group.

    Per input row: id, keep_id, group_size, kept, text_sha256 (hex of the normalised text). ``keep``: "min" or "max" id by
    the order of the id's type, numbers or strings; a null id stays only where its group has no other. Of repeated rows
    (same id and text) all count in group_size, and all of the id that stays are kept: give a row number as the id to keep
    one row. An empty table gives no rows; other columns don't matter. Whatever a digest's share of the rows, its entries
    are pre-aggregated before the shuffle, and the joins are plain sort-merge joins, whose skewed partitions Spark splits.
    Texts with equal digests that differ in a byte are grouped by text.
    """
    text = docs.select(F.col(id_column).alias("id"), normalised(F.col(text_column).cast("string")).alias("body"))
    hashed = text.select("id", "body", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"))
    index = DigestIndex(docs.sparkSession, keep=keep)
    index.flush(hashed.select("digest", "id"))
    level = index.compact()

    # Hits: texts whose digest passes the filter, with the index entry; the text of the row that stays is among them.
    hits = materialise(_front(hashed, level).join(level.where("n > 1").select("digest", "keep_id"), "digest"), "lsm-hits")
    stays = materialise(hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).select("digest", F.col("body").alias("kept_body")).dropDuplicates(["digest"]), "lsm-stays")
    verified = materialise(hits.join(stays, "digest").where(F.col("body") != F.col("kept_body")).select("digest", "id", F.col("body").alias("other")), "lsm-strays")

    # Digest collisions, none in practice: these rows leave the index group and are grouped by their text.
    strays = verified.join(verified.groupBy("digest", "other").agg(index.best("id").alias("stray_keep"), F.count(F.lit(1)).alias("stray_n")), ["digest", "other"])
    strays = strays.select(F.col("digest").alias("sd"), F.col("id").alias("si"), "stray_keep", "stray_n").distinct()
    lost = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    member = index.entries().select("digest", "id").join(level, "digest")
    member = member.join(lost, "digest", "left").join(strays, (F.col("digest") == F.col("sd")) & F.col("id").eqNullSafe(F.col("si")), "left")
    keep_id = F.when(F.col("sd").isNull(), F.col("keep_id")).otherwise(F.col("stray_keep"))
    size = F.when(F.col("sd").isNull(), F.col("n") - F.coalesce("lost", F.lit(0))).otherwise(F.col("stray_n"))
    return member.select(F.col("id").alias(id_column), keep_id.alias("keep_id"), size.cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, rows: DataFrame, *, text_column: str = "text") -> DataFrame:
    """Of the numbered rows (row, doc) of docs one of each group of equal texts, the first, with the columns of docs. Repeated rows and null ids are rows like any other."""
    kept = exact_dedup(rows.select("row", F.col(f"doc.`{text_column}`").alias("text")), id_column="row", text_column="text").where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
