"""WARC archives: a writer with revisit records and a salvage reader.

The reader takes archives of gzip members, plain ones and damaged ones. Where a check fails (member checksum, version line,
header, length, end of record, block digest) it searches for the next valid member or version line, goes on there, and logs
the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.llm.storage import arrow_batches, materialise, scratch

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "<urn:x-page:%s>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record, not compressed. A revisit has the HTTP header of the full payload and no payload."""
    named = lambda x: _RECORD_ID % ("null" if x is None else x)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if revisit:
        head += [f"WARC-Refers-To: {named(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Salvaged:
    records: list[tuple[dict[str, str], bytes]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


_LENGTH = re.compile(r"\d{1,18}")


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at a version line, and where it ends. ValueError: the check that failed."""
    if data[at : at + 5] != b"WARC/":
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header has no end")
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line has no colon")
        head[name.strip().lower()] = value.strip()
    if not _LENGTH.fullmatch(head.get("content-length", "")):
        raise ValueError("no content length")
    begin, end = stop + 4, stop + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record has no end")
    block = data[begin:end]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != base32_sha1(block):
        raise ValueError("block digest differs")
    said = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and said.startswith("sha1:") and said[5:] != base32_sha1(block.partition(b"\r\n\r\n")[2]):
        raise ValueError("payload digest differs")
    return head, block, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at this place gives, where it ends, and the check that failed."""
    machine = zlib.decompressobj(31)
    out = []
    view = memoryview(data)
    pos = at
    try:
        while pos < len(data) and not machine.eof:
            out.append(machine.decompress(view[pos : pos + (1 << 16)]))
            pos += 1 << 16
    except zlib.error as e:
        return b"".join(out), at, f"member: {e}"
    if not machine.eof:
        return b"".join(out), at, "member is cut off"
    return b"".join(out), min(pos, len(data)) - len(machine.unused_data), ""


def _next_start(data: bytes, at: int) -> int:
    """The next place from here with a version line, or with a member that begins with one; else the end."""
    plain, packed = at, at
    while True:
        plain = data.find(b"WARC/", plain)
        plain = len(data) if plain < 0 else plain
        packed = data.find(MAGIC, packed)
        packed = len(data) if packed < 0 else packed
        first = min(plain, packed)
        if first == len(data) or first == plain:
            return first
        try:
            if zlib.decompressobj(31).decompress(data[packed : packed + 512], 5) == b"WARC/":
                return packed
        except zlib.error:
            pass
        packed += 1


def salvage(data: bytes) -> Salvaged:
    """All records that pass their checks, and the byte ranges (first, end, reason) that hold none."""
    out, at = Salvaged(), 0
    while at < len(data):
        why, end = "", at
        if data.startswith(MAGIC, at):
            content, end, why = _inflate(data, at)
            place = 0
            while place < len(content):
                try:
                    head, block, place = _parse(content, place)
                    out.records.append((head, block))
                except ValueError as e:
                    why = why or f"in member: {e}"
                    later = content.find(b"\r\n" + VERSION[:5], place + 1)
                    if later < 0:
                        break
                    place = later + 2
            if why and end > at:  # the member is whole, but not all that it holds
                out.gaps.append((at, end, why))
                at = end
                continue
        else:
            try:
                head, block, end = _parse(data, at)
                out.records.append((head, block))
            except ValueError as e:
                why = str(e)
        if why:
            end = _next_start(data, at + 1)
            if out.gaps and out.gaps[-1][1] == at:
                out.gaps[-1] = (out.gaps[-1][0], end, out.gaps[-1][2])
            else:
                out.gaps.append((at, end, why))
        at = end
    return out


def write_archives(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 0, archive_bytes: int = 16 << 20, folder: str | None = None) -> str:
    """Write one record per row into archives of about ``archive_bytes`` in a shared folder, and return the folder.

    Null payloads are empty. Of rows with equal payloads of at least ``min_bytes`` bytes those with the largest id are
    responses and the others revisit it; a null id is the largest only among nulls. Rows are in a fixed order inside a
    task, so a task that runs again writes the same files; a file appears under its name only when it is whole.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    first = rows.groupBy("key").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same: Column = F.col("id").eqNullSafe(F.col("keeper"))
    rows = rows.join(first, "key", "left").withColumn("revisit", F.col("n").isNotNull() & ~same & (F.octet_length("payload") >= min_bytes))
    rows = rows.sortWithinPartitions("key", "id", "url").select("id", "url", "payload", "keeper", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        parts, size, number, total = [], 0, 0, 0

        def close() -> None:
            nonlocal parts, size, number
            if parts:
                name = f"part-{task:06d}-{number:05d}.warc.gz"
                with system.open_output_stream(f"{base}/_{attempt}-{name}", compression=None) as f:
                    for x in parts:
                        f.write(x)
                if system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                    system.delete_file(f"{base}/{name}")  # of an attempt that was lost
                system.move(f"{base}/_{attempt}-{name}", f"{base}/{name}")
                number += 1
            parts, size = [], 0

        for batch in batches:
            for r in batch.to_pylist():
                parts.append(member(record(r["id"], r["url"], r["payload"], r["keeper"], r["revisit"])))
                size, total = size + len(parts[-1]), total + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([total], pa.int64())], ["files", "records"])

    rows.mapInArrow(run, "files long, records long").agg(F.sum("files"), F.sum("records")).collect()
    return folder


_NUMBER = re.compile(r"<urn:x-page:(-?\d+)>")
RECORD = T.StructType([T.StructField(a, b) for a, b in (("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("url", T.StringType()), ("payload", T.BinaryType()))])
GAP = T.StructType([T.StructField("archive", T.StringType()), T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("reason", T.StringType())])


def _archives(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row per archive; none if the folder has no archive."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path) or not len(system.listStatus(path)):
        return None
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")


def _field(head: dict[str, str], block: bytes) -> tuple:
    number = lambda x: int(m[1]) if (m := _NUMBER.fullmatch(x or "")) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type")
    size = len(payload)
    if kind == "revisit":  # the HTTP header tells the size of the payload that isn't here
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(m[1]) if m else None
    return number(head.get("warc-record-id")), size, head.get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(payload), kind, number(head.get("warc-refers-to")), head.get("warc-target-uri"), payload


def salvage_archives(spark: SparkSession, folder: str, *, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives in a folder, in one read: the fields of RECORD, then those of GAP; a record has no reason.

    An archive is read by one task, so keep them small. Records pass their checks: checksum of the member, version line,
    length, end, and block and payload digests, which are computed again. An empty or missing folder gives no rows.
    """
    schema = T.StructType([*(RECORD.fields if with_payload else RECORD.fields[:-1]), *GAP.fields])
    found = _archives(spark, folder)
    if found is None:
        return spark.createDataFrame([], schema)
    arrow_batches(spark)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if with_payload else []), pa.string(), pa.int64(), pa.int64(), pa.string()]
    width = len(kinds) - len(GAP.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                got = salvage(batch.column(1)[i].as_py())
                rows = [(*_field(*x)[:width], path, None, None, None) for x in got.records] + [(*[None] * width, path, *g) for g in got.gaps]
                for k in range(0, len(rows), 2000):
                    part = [*zip(*rows[k : k + 2000], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], schema.names)

    return found.mapInArrow(run, schema)


def read_archives(spark: SparkSession, folder: str, *, with_payload: bool = True) -> DataFrame:
    """The records of salvage_archives."""
    return salvage_archives(spark, folder, with_payload=with_payload).where("reason is null").drop(*GAP.names)


def read_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The quarantined byte ranges of salvage_archives."""
    return salvage_archives(spark, folder, with_payload=False).where("reason is not null").select(*GAP.names)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null and repeated ids, null, empty and very long payloads and null urls come back as they went in; other columns don't
    matter; an empty table gives no rows. What one read finds is kept in a table; gaps in it are logged.
    """
    found = materialise(salvage_archives(pages.sparkSession, write_archives(pages, **options), with_payload=False), "warc-read")
    for r in found.where("reason is not null").orderBy("archive", "first_byte").limit(100).collect():
        logging.getLogger(__name__).warning("quarantined %s bytes %d to %d: %s", r.archive, r.first_byte, r.end_byte, r.reason)
    return found.where("reason is null").drop("url", *GAP.names)
