"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of id and text; a source has at most ``MAX_BLOCKS`` blocks, of about
``block_words`` words each, and a block that repeated rows make too large is split. The target of a source is its quota: so many whole passes over its blocks, and of one more
pass the first blocks of a permutation until the words suffice, where the last document is cut. The tree halves the output
shards again and again; at each node a multivariate-hypergeometric draw over the sources' remaining block quotas says what
the left half gets, so that all quotas come out exactly. A shard draws its quota as the next unused blocks of the source's
permutation, so shards are disjoint, and then shuffles its documents by a hash of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapwarden.llm.storage import materialise
from snapwarden.llm.words import WORD

MAX_BLOCKS = 65_536
#: Words of an output shard and of one task's slice of it; shards times sources is bounded, as the driver draws their quotas.
SHARD_WORDS, SLICE_WORDS, MAX_CELLS = 1 << 23, 1 << 22, 1 << 22


def targets(sizes: dict[str | None, int], weights: Sequence[float], total: float, cap: float) -> dict[str | None, float]:
    """Target of each source. Sources by code point, null last, take the weights in turn; none gets over cap times its size."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    share = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left = total
    while len(out) < len(order):
        free = [s for s in order if s not in out]
        all_weights = sum(share[s] for s in free)
        full = [s for s in free if left * share[s] / all_weights > cap * sizes[s]]
        if not full:
            return out | {s: left * share[s] / all_weights for s in free}
        out |= {s: float(cap * sizes[s]) for s in full}
        left = total - sum(out.values())
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Row k: the blocks that shard k takes of each source. Columns sum to the quotas; shards' totals differ by one at most."""
    out, rng = np.zeros((shards, len(quotas)), np.int64), np.random.Generator(np.random.PCG64(seed))

    def node(first: int, last: int, rest: np.ndarray) -> None:
        if last - first == 1:
            out[first] = rest
            return
        mid = (first + last) // 2
        want = int(rest.sum()) * (mid - first) // (last - first)
        left = rng.multivariate_hypergeometric(rest, want, method="marginals") if rest.sum() else rest
        node(first, mid, left)
        node(mid, last, rest - left)

    node(0, shards, quotas)
    return out


def plan(rows: DataFrame, *, weights: Sequence[float] = (5, 2, 1), factor: float = 1.5, cap: float = 2.0, shards: int | None = None, block_words: int = 1 << 17, seed: int = 20, max_sources: int = 200_000) -> tuple[DataFrame, DataFrame, int]:
    """rows (row, id, hash, source, size), held in a table → draws (row, copy, shard, place, words), sources (source, source_size, target) and the number of shards, which grows with the words.

    Only totals by source come to the driver; more than ``max_sources`` sources are refused, as a mixture by weight has no
    sense there. Nulls: a null source is a source of its own. Ties in the hash go by id, size and row.
    """
    spark = rows.sparkSession
    sums = {r["source"]: int(r["n"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()}
    if len(sums) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    goal = targets(sums, weights, factor * sum(sums.values()), cap)
    names = [*sums]
    shards = shards or max(16, min(MAX_CELLS // max(1, len(names)), math.ceil(sum(goal.values()) / SHARD_WORDS)))
    whole = {s: int(goal[s] // sums[s]) if sums[s] else 0 for s in names}
    part = {s: round(goal[s] - whole[s] * sums[s]) if sums[s] else 0 for s in names}
    count = {s: min(MAX_BLOCKS, max(1, math.ceil(sums[s] / block_words))) for s in names}
    sources = spark.createDataFrame([(s, sums[s], goal[s], whole[s], part[s], count[s]) for s in names], "source string, source_size long, target double, whole int, part long, n_blocks long")

    small = F.broadcast(sources.select(F.col("source").alias("s"), "whole", "part", "n_blocks"))
    lot = F.shiftrightunsigned(F.xxhash64("id", "hash", F.lit(seed)), 32)
    blocked = rows.join(small, F.col("source").eqNullSafe(F.col("s"))).select("row", "id", "hash", "source", "size", "whole", "part", F.shiftright(lot * F.col("n_blocks"), 32).alias("block"))
    # Rows with one id and text are in one block: where they make it too large, they are dealt to further blocks by row.
    large = blocked.groupBy(F.col("source").alias("ls"), F.col("block").alias("lb")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
    limits = F.broadcast(sources.select(F.col("source").alias("s"), F.greatest(F.lit(block_words), F.ceil(F.col("source_size") / F.col("n_blocks"))).alias("limit")))
    large = materialise(large.join(limits, F.col("ls").eqNullSafe(F.col("s"))).where((F.col("w") > 4 * F.col("limit")) & (F.col("n") > 1)).select("ls", "lb", "limit"), "mix-large")
    if not large.isEmpty():
        inside = blocked.join(large, F.col("source").eqNullSafe(F.col("ls")) & (F.col("block") == F.col("lb")))
        again = inside.groupBy("ls", F.col("id").alias("li"), F.col("hash").alias("lh"), "limit").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("w") > F.col("limit")))
        again = materialise(again.select("ls", "li", "lh", F.ceil(F.col("w") / F.col("limit")).cast("long").alias("ways")), "mix-repeated")
        further = (F.col("block") + 1) * MAX_BLOCKS + F.pmod(F.xxhash64("row", F.lit(seed + 3)), F.col("ways"))
        repeated = F.col("source").eqNullSafe(F.col("ls")) & F.col("id").eqNullSafe(F.col("li")) & (F.col("hash") == F.col("lh"))
        blocked = blocked.join(again, repeated, "left").withColumn("block", F.when(F.col("ways").isNotNull(), further).otherwise(F.col("block"))).drop("ls", "li", "lh", "ways")
    blocks = blocked.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("part").alias("part"))
    passes = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole"))))  # the last one is the part
    turn = Window.partitionBy("source", "copy").orderBy(F.xxhash64("source", "block", "copy", F.lit(seed + 1)), "block")
    passes = passes.withColumn("turn", F.row_number().over(turn) - 1).withColumn("before", F.coalesce(F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    need = F.when(F.col("copy") < F.col("whole"), F.col("words")).otherwise(F.greatest(F.lit(0), F.least("words", F.col("part") - F.col("before"))))
    passes = materialise(passes.withColumn("need", need).where("need > 0"), "mix-blocks")

    # Of each source, its passes one after another make the list of blocks that shards draw from.
    quota = {(r["source"], r["copy"]): r["n"] for r in passes.groupBy("source", "copy").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = np.array([sum(quota.get((s, c), 0) for c in range(whole[s] + 1)) for s in names], np.int64)
    ends = np.cumsum(split(per, shards, seed), axis=0)
    lists = [(s, c, int(sum(quota.get((s, x), 0) for x in range(c))), [int(x) for x in ends[:, i]]) for i, s in enumerate(names) for c in range(whole[s] + 1)]
    table = spark.createDataFrame(lists, "ls string, lc int, skip long, ends array<long>") if lists else spark.createDataFrame([], "ls string, lc int, skip long, ends array<long>")
    drawn = passes.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("ls")) & (F.col("copy") == F.col("lc")))
    drawn = drawn.select(F.col("source").alias("bs"), F.col("block").alias("bb"), "copy", F.expr("size(filter(ends, e -> e <= skip + turn))").alias("shard"), "need", (F.col("need") < F.col("words")).alias("short"))
    took = blocked.join(drawn, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")))
    place = F.shiftrightunsigned(F.xxhash64("id", "hash", "copy", F.lit(seed + 2)), 1)
    took = took.select("row", "id", "source", "block", "size", "copy", "shard", "need", "short", place.alias("place"))
    line = Window.partitionBy("source", "block").orderBy("place", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    cut = took.where("short").withColumn("w", F.greatest(F.lit(0), F.least("size", F.col("need") - F.coalesce(F.sum("size").over(line), F.lit(0)))))
    draws = took.where("not short").select("row", "copy", "shard", "place", F.col("size").alias("words")).unionByName(cut.where("w > 0").select("row", "copy", "shard", "place", F.col("w").alias("words")))
    return draws, sources.select("source", "source_size", "target"), shards


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, with_docs: bool) -> DataFrame:
    """A table (row, id, hash, source, size), with the document as a struct if asked for. Row numbers tell repeated rows apart."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if with_docs else []
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.xxhash64(text).alias("hash"), F.col(source_column).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *own), "mix-rows")


def mix_counts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """Per input row: id, size (words), source_size, target of its source, taken (words that the mix takes, repeats counted).

    A null text has size 0; a document of size 0 isn't taken. An empty table gives no rows. Repeated rows are drawn one by
    one. A document is taken at most ``cap`` times. Other columns don't matter. The same files give the same result; where
    no id and text is repeated very often, it doesn't depend on how the input is partitioned either.
    """
    rows = sized(docs, id_column, text_column, source_column, False)
    draws, sources, _ = plan(rows, **options)
    got = draws.groupBy("row").agg(F.sum("words").alias("taken")).withColumnRenamed("row", "r")
    named = F.broadcast(sources.withColumnRenamed("source", "s"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("s"))).join(got, F.col("row") == F.col("r"), "left").select(F.col("id").alias(id_column), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _drawn(docs: DataFrame, id_column: str, text_column: str, source_column: str, options: dict) -> tuple[DataFrame, int, DataFrame]:
    """(doc, shard, place) of all draws, the number of shards, and the sources."""
    rows = sized(docs, id_column, text_column, source_column, True)
    draws, sources, shards = plan(rows.drop("doc"), **options)
    chosen = draws.withColumnRenamed("row", "r").join(rows.select("row", "size", "doc"), F.col("r") == F.col("row"))
    given = F.col(f"doc.`{text_column}`")
    first = F.array_join(F.slice(F.regexp_extract_all(given, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), first).otherwise(given)
    doc = F.struct(*[(text if c == text_column else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
    return chosen.select(doc.alias("doc"), "shard", "place"), shards, sources


def mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of docs and mix_shard, mix_place. Sort a shard by place to have its documents in shuffled order.

    A document drawn twice is there twice. Of each source at most one document is cut: it holds its first words, with one
    space between. Nulls, repeated rows and empty tables as in mix_counts.
    """
    drawn, _, _ = _drawn(docs, id_column, text_column, source_column, options)
    return drawn.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns], F.col("shard").alias("mix_shard"), F.col("place").alias("mix_place"))


def mixed_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mix with the columns of docs alone, whatever they are called: each task has a slice of a shard in shuffled order."""
    drawn, shards, sources = _drawn(docs, id_column, text_column, source_column, options)
    total = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    slices = max(1, math.ceil(total / shards / SLICE_WORDS))
    at = F.shiftright(F.shiftright("place", 31) * F.lit(slices), 32)
    n = max(1, min(shards * slices, math.ceil(total / SLICE_WORDS)))
    return drawn.withColumn("slice", at).repartition(n, "shard", "slice").sortWithinPartitions("shard", "place").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
