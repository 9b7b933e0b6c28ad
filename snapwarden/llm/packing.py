"""Mixture-controlled packing of token streams into windows of fixed length by deficit round-robin.

Each source is a queue of its documents' tokens, in the order of partitions and rows. At each window every queue that has
tokens left is owed its share of the window by weight. The queues are served in turn: one takes whole documents while its
deficit lasts, overdrawn by at most ``slack``, or a part of a document where a deficit of ``least`` or more meets a longer
one; what is left of the window goes to the queues that are owed most. Deficits go on from window to window.

To run on many machines, the order is cut into lanes of ``lane_windows`` windows. Served by weight alone, without documents,
a queue's token x goes out at time x / weight, and all tokens before that time are known from the queues' totals and
weights. So a lane's part of each queue is a range of its tokens that a task finds by itself, a lane begins with every
queue within a token of what it is owed, and round-robin inside the lane holds the deficits. What a lane has beyond whole
windows, less than one, goes into further windows with what the next lanes have; only the last of these is shorter, and it
is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.llm.storage import arrow_batches, materialise
from snapwarden.llm.tokens import default_path, encoder
from snapwarden.llm.words import byte_slices, text_array, tidied

#: More sources than this share queues by a hash of their names, so the table of totals stays small.
MAX_QUEUES = 65_536
#: Lanes whose running totals are taken in one task.
GROUP = 4096
#: Rows of the table of queues' places by partition that are broadcast, about 16 MB; a longer one is joined by a shuffle.
MOST_LOTS = 200_000
#: Bytes of token ids of one task where the session's number of shuffle partitions is too small for them.
TASK_BYTES = 32 << 20
_SPARK = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
_TOKENS = [("part", pa.int32()), ("source", pa.string()), ("local", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
_CUT = [("source", pa.string()), ("queue", pa.int32()), ("lane", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
_PLACED = [("source", pa.string()), ("lane", pa.int64()), ("number", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]


def _schema(kind: T.DataType, fields: list) -> T.StructType:
    return T.StructType([T.StructField("key", kind), *[T.StructField(n, _SPARK[t]) for n, t in fields]])


def _batch(rows: list[tuple], kind: pa.DataType, fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *[t for _, t in fields]], strict=True)], ["key", *[n for n, _ in fields]])


def _tokenise(end_id: int, path: str, narrow: bool, batch_bytes: int):
    """(key, source, text) → the documents' ids, with the place of each in its source's queue of this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, filled = encoder(path), TaskContext.get().partitionId(), {}
        kind = np.dtype("<u2" if narrow else "<u4")
        for batch in batches:
            texts, sources = text_array(batch.column(2)), batch.column(1).to_pylist()
            for a, b in byte_slices(texts, batch_bytes):
                tokens, ends = own.ids(texts.slice(a, b - a))
                sizes = np.diff(ends) + 1
                stops = np.cumsum(sizes)
                ids = np.full(int(stops[-1]), end_id, kind)
                own_place = np.ones(len(ids), bool)
                own_place[stops - 1] = False
                ids[own_place] = tokens
                offsets = np.concatenate([[0], stops * kind.itemsize]).astype(np.int32)
                local = []
                for source, n in zip(sources[a:b], sizes.tolist(), strict=True):
                    local.append(filled.get(source, 0))
                    filled[source] = local[-1] + n
                blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), batch.column(1).slice(a, b - a), pa.array(local, pa.int64()), pa.array(sizes, pa.int64()), blobs], ["key", *[n for n, _ in _TOKENS]])

    return run


@dataclass
class Schedule:
    """When queues of given totals and weights go out if each is served by its weight until it ends."""

    totals: np.ndarray
    weights: np.ndarray
    lanes: int

    def __post_init__(self) -> None:
        self.ends = self.totals / self.weights
        order = np.argsort(self.ends, kind="stable")
        rates = np.cumsum(self.weights[order][::-1])[::-1]
        times = self.ends[order]
        steps = np.diff(np.concatenate([[0.0], times])) * rates
        self.times, self.served = np.concatenate([[0.0], times]), np.concatenate([[0.0], np.cumsum(steps)])
        self.all = int(self.totals.sum())

    def border(self, lane: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Tokens of the queue that go out before the lane."""
        time = np.interp(np.asarray(lane, float) / self.lanes * self.served[-1], self.served, self.times)
        before = np.minimum(np.floor(self.weights[queue] * time + 1e-9).astype(np.int64), self.totals[queue])
        return np.where((np.asarray(lane) >= self.lanes) | (time >= self.ends[queue]), self.totals[queue], before)

    def lane(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The lane of the queue's token."""
        served = np.interp(at / self.weights[queue], self.times, self.served)
        lane = np.clip((served / max(self.served[-1], 1e-300) * self.lanes).astype(np.int64), 0, self.lanes - 1)
        while (early := self.border(lane, queue) > at).any():
            lane = lane - early
        while (late := self.border(lane + 1, queue) <= at).any():
            lane = lane + late
        return lane


def _cut(plan: Schedule, narrow: bool):
    """(key, source, queue, at, doc_tokens, ids) → documents' parts by lane."""
    width = 2 if narrow else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queue, at, size = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
            first, last = plan.lane(queue, at), plan.lane(queue, at + size - 1)
            whole = first == last
            easy, at_easy = batch.filter(pa.array(whole)), at[whole]
            if easy.num_rows:
                yield pa.RecordBatch.from_arrays([easy.column(0), easy.column(1), pa.array(queue[whole].astype(np.int32)), pa.array(first[whole]), pa.array(at_easy), pa.array(np.zeros(len(at_easy), np.int64)), easy.column(4), easy.column(5)], ["key", *[n for n, _ in _CUT]])
            rows = []
            for i in np.flatnonzero(~whole).tolist():
                q, x, n = int(queue[i]), int(at[i]), int(size[i])
                key, source, ids = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(5)[i].as_buffer()
                lanes = np.arange(first[i], last[i] + 1)
                stops = np.minimum(plan.border(lanes + 1, np.full(len(lanes), q)), x + n) - x
                done = 0
                for lane, stop in zip(lanes.tolist(), stops.tolist(), strict=True):
                    if stop > done:
                        rows.append((key, source, q, lane, x + done, done, n, ids.slice(width * done, width * (stop - done)).to_pybytes()))
                        done = stop
            if rows:
                yield _batch(rows, batch.column(0).type, _CUT)

    return run


class _Lane:
    """Deficit round-robin over the queues of one lane."""

    def __init__(self, weights: np.ndarray, window: int, slack: int, least: int):
        self.weights, self.window, self.slack, self.least = weights, window, slack, least

    def fill(self, queues: dict[int, list[list]]) -> Iterator[list[list]]:
        """queues: by number lists of [piece, first token, tokens left]. Gives each window's [piece, first, length], the part window last."""
        owed = dict.fromkeys(sorted(queues), 0.0)
        heads = {q: 0 for q in owed}
        left = sum(p[2] for own in queues.values() for p in own)
        turn = 0
        while left:
            room = size = min(self.window, left)
            active = [q for q in owed if heads[q] < len(queues[q])]
            weight, due = sum(self.weights[q] for q in active), size - sum(owed[q] for q in active)
            for q in active:
                owed[q] += due * self.weights[q] / weight
            out: list[list] = []

            def take(q: int, n: int) -> None:
                piece = queues[q][heads[q]]
                if out and out[-1][0] is piece[0] and out[-1][1] + out[-1][2] == piece[1]:
                    out[-1][2] += n
                else:
                    out.append([piece[0], piece[1], n])
                piece[1], piece[2] = piece[1] + n, piece[2] - n
                owed[q] -= n
                if not piece[2]:
                    heads[q] += 1

            first = turn % len(active)
            for q in active[first:] + active[:first]:
                while room and owed[q] >= 1 and heads[q] < len(queues[q]):
                    n = queues[q][heads[q]][2]
                    if n > owed[q] + self.slack:
                        if owed[q] < self.least:
                            break
                        n = int(owed[q])
                    n = min(n, room)
                    take(q, n)
                    room -= n
            while room:
                q = max((q for q in active if heads[q] < len(queues[q])), key=owed.__getitem__)
                n = min(queues[q][heads[q]][2], room, max(int(owed[q]), 0) + self.slack)
                take(q, n)
                room -= n
            left -= size
            turn += 1
            yield out


def _place(weights: np.ndarray, window: int, slack: int, least: int, narrow: bool, with_ids: bool):
    """Sorted parts of lanes → pieces at their windows. Number -1: beyond the lane's whole windows, with ids of 4 bytes."""
    width, server = 2 if narrow else 4, _Lane(weights, window, slack, least)

    def lane_rows(lane: int, held: list[tuple]) -> list[tuple]:
        queues: dict[int, list[list]] = {}
        for r in held:
            queues.setdefault(r[2], []).append([r, 0, len(r[7]) // width])
        rows = []
        for number, pieces in enumerate(server.fill(queues)):
            whole, offset = sum(p[2] for p in pieces) == window, 0
            for r, first, n in pieces:
                ids = r[7][width * first : width * (first + n)]
                ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes() if narrow else ids
                rows.append((r[0], r[1], lane, number if whole else -1, r[5] + first, n, r[6], offset, zlib.crc32(ids), ids if with_ids or not whole else None))
                offset += n
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held, kind = None, [], pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[3] != lane:
                    if held:
                        yield _batch(lane_rows(lane, held), kind, _PLACED)
                    lane, held = r[3], []
                held.append(r)
        if held:
            yield _batch(lane_rows(lane, held), kind, _PLACED)

    return run


def _before(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """table (lane, columns) with the sum of each column over the lanes before. Groups of lanes first, so no task sees all lanes."""
    grouped = table.withColumn("g", F.expr(f"lane div {GROUP}"))
    line = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row for GROUP lanes
    heads = grouped.groupBy("g").agg(*[F.sum(c).alias(c) for c in columns]).select(F.col("g").alias("hg"), *[F.coalesce(F.sum(c).over(line), F.lit(0)).alias(f"h_{c}") for c in columns])
    own = Window.partitionBy("g").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.select("lane", "g", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"i_{c}") for c in columns])
    return inner.join(heads, F.col("g") == F.col("hg")).select("lane", *[(F.col(f"h_{c}") + F.col(f"i_{c}")).alias(f"before_{c}") for c in columns])


def _shares(names: list, totals: list[int], weights: Sequence[float] | Mapping[str | None, float] | None) -> np.ndarray:
    if weights is None:
        return np.array(totals, float)
    if isinstance(weights, Mapping):
        out = np.array([float(weights.get(n, 1.0)) for n in names])
    else:
        out = np.array([float(weights[i % len(weights)]) for i in range(len(names))])
    if not (out > 0).all():
        raise ValueError("weights must be above 0")
    return out


def pack(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", window: int = 4096, end_id: int = 2, path: str | None = None, weights: Sequence[float] | Mapping[str | None, float] | None = None, slack: int | None = None, least: int | None = None, lane_windows: int = 64, with_ids: bool = False, batch_bytes: int = 2 << 20) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and with ``with_ids`` its ids (4 bytes each, little-endian).

    ``weights``: target proportion by source; a sequence is dealt to the sources by code point, null last, again and again;
    a mapping leaves 1 for sources that it lacks; without weights each source has its share of all tokens, so that all
    queues end together. A source with a larger weight than its share ends early, the others go on in their proportions;
    none is left out. In a window a source is off its target by at most ``slack`` + ``least`` tokens (1/16 and 1/32 of the
    window if not given) and what single documents of other sources leave; the last windows hold what the lanes left.

    A null text is an empty one and gives the end id alone; a null source is a source of its own; repeated rows are packed
    as often as they come; null ids are kept. Other columns don't matter. An empty table gives no rows. A very long text
    goes through many windows. Over MAX_QUEUES sources share queues by a hash. The same files give the same result.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    arrow_batches(spark)
    path, slack, least = path or default_path(), slack or max(window // 16, 1), least or max(window // 32, 1)
    narrow = max(encoder(path).size, end_id + 1) <= 1 << 16
    kind = docs.schema[id_column].dataType
    given = docs.select(F.col(id_column).alias("key"), F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("text"))
    tokens = materialise(given.mapInArrow(tidied(_tokenise(end_id, path, narrow, batch_bytes)), _schema(kind, _TOKENS)), "pack-tokens")

    # Totals of the queues, and where each partition's tokens begin in them.
    lots = materialise(tokens.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n")), "pack-lots")
    few = lots.limit(MOST_LOTS + 1).count() <= MOST_LOTS
    sums = lots.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.asc_nulls_last("source")).limit(MAX_QUEUES + 1).collect()
    if len(sums) > MAX_QUEUES:
        lots = lots.withColumn("queue", F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES)).cast("int"))
        by = {r["queue"]: r["n"] for r in lots.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
        names, totals = [*range(MAX_QUEUES)], [by.get(q, 0) for q in range(MAX_QUEUES)]
    else:
        names, totals = [r["source"] for r in sums], [r["n"] for r in sums]
        numbers = F.broadcast(spark.createDataFrame([*zip(names, range(len(names)), strict=True)], "s string, queue int"))
        lots = lots.join(numbers, F.col("source").eqNullSafe(F.col("s")))
    if not sums:
        totals, names = [0], [None]
    shares = np.maximum(_shares(names, totals, weights), 1e-9)
    plan = Schedule(np.array(totals, np.int64), shares, max(1, round(sum(totals) / (window * lane_windows))))
    line = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = lots.select(F.col("part").alias("p"), F.col("source").alias("s"), "queue", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    queued = tokens.join(F.broadcast(bases) if few else bases, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("key", "source", "queue", (F.col("base") + F.col("local")).alias("at"), "doc_tokens", "ids")

    cut = queued.mapInArrow(tidied(_cut(plan, narrow)), _schema(kind, _CUT))
    tasks = sum(totals) * (2 if narrow else 4) // TASK_BYTES
    lanes = (cut.repartition(tasks, "lane") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else cut.repartition("lane")).sortWithinPartitions("lane", "queue", "at")
    placed = materialise(lanes.mapInArrow(tidied(_place(plan.weights, window, slack, least, narrow, with_ids)), _schema(kind, _PLACED)), "pack-placed")

    # Numbers of the lanes' windows, and the windows made of what lanes have left.
    per = placed.groupBy("lane").agg((F.coalesce(F.max("number"), F.lit(-1)) + 1).alias("full"), F.coalesce(F.sum(F.when(F.col("number") < 0, F.col("length"))), F.lit(0)).alias("rest"))
    per = materialise(per.select("lane", F.greatest("full", F.lit(0)).cast("long").alias("full"), F.col("rest").cast("long").alias("rest")), "pack-lanes")
    full, rest = per.agg(F.coalesce(F.sum("full"), F.lit(0)), F.coalesce(F.sum("rest"), F.lit(0))).first()
    known = placed.join(_before(per, ["full", "rest"]), "lane")
    shown = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", *(["ids"] if with_ids else [])]
    main = known.where("number >= 0").withColumn("sequence_id", F.col("before_full") + F.col("number")).select(*shown)

    whole = rest // window * window
    edges = [whole + (rest - whole >> b + 1 << b + 1) for b in range(window.bit_length()) if rest - whole >> b & 1][::-1]  # begins of the powers of two
    begin = F.array(*[F.lit(e).cast("long") for e in [*edges, rest]])
    tail = known.where("number < 0").withColumn("lo", F.col("before_rest") + F.col("offset")).withColumn("hi", F.col("lo") + F.col("length"))
    inside = F.expr(f"filter(sequence(lo div {window}, (hi - 1) div {window}), k -> k * {window} < {whole})")
    marks = F.concat(F.transform(inside, lambda k: F.struct(k.cast("long").alias("k"), (k * window).cast("long").alias("a"), ((k + 1) * window).cast("long").alias("b"))), F.transform(F.slice(begin, 1, len(edges)), lambda a, i: F.struct((F.lit(whole // window) + i).cast("long").alias("k"), a.alias("a"), F.get(begin, i + 1).alias("b"))))
    tail = tail.withColumn("m", F.explode(F.filter(marks, lambda m: (m["a"] < F.col("hi")) & (m["b"] > F.col("lo")))))
    tail = tail.withColumn("x", F.greatest("lo", "m.a")).withColumn("y", F.least("hi", "m.b"))
    tail = tail.withColumn("part_ids", F.expr("substring(ids, cast(4 * (x - lo) + 1 as int), cast(4 * (y - x) as int))"))
    tail = tail.select("key", (F.col("start") + F.col("x") - F.col("lo")).alias("start"), (F.col("y") - F.col("x")).alias("length"), F.crc32("part_ids").alias("ids_crc32"), "doc_tokens", (F.lit(full) + F.col("m.k")).alias("sequence_id"), (F.col("x") - F.col("m.a")).alias("offset"), "source", F.col("part_ids").alias("ids")).select(*shown)
    return main.unionByName(tail).withColumnRenamed("key", id_column)
