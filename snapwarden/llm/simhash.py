"""SimHash near-duplicates with pivot distance tables.

Two fingerprints that differ in at most k bits have distances to any reference fingerprint that differ by at most k. A table
of the distances to many references therefore discards a pair as soon as one coordinate differs by more than k; what is
left is verified bit by bit.

The table has two kinds of references. Unit references (zero and the 64 single bits) sit in BLOCKS groups: a fingerprint's
distances to the references of a group, less its distance to zero, give its bits there. As k differing bits touch at most
k groups, a linked pair has equal coordinates in BLOCKS - k groups, so only fingerprints that agree in one of these choices
of groups are brought together; this keeps the work from growing with the square of the corpus. Inside such a bucket,
pseudo-random references discard pairs by the largest coordinate difference. Only a spanning set of links leaves a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.llm.components import components
from snapwarden.llm.storage import arrow_batches, materialise
from snapwarden.llm.words import byte_slices, text_array, tidied

BLOCKS = 6
SEED = 42
#: Fingerprints of one bucket; larger buckets are split by the bits that their members don't share.
LARGE = 20_000


def _block_masks(blocks: int = BLOCKS) -> list[int]:
    """Bits of each group of unit references, as equal as 64 allows."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def bucket_masks(k: int, blocks: int = BLOCKS) -> list[int]:
    """One mask for each choice of blocks - k groups."""
    return [sum(c) for c in combinations(_block_masks(blocks), blocks - k)]


def references(n: int, seed: int = 7) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Row i: Hamming distances of fingerprint i to all references."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def spanning_links(prints: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the fingerprints that chains of at most k differing bits connect.

    The fingerprints are sorted by their first coordinate, so that a search looks only at the rows where it differs by at
    most k; a row that has been reached is not looked at again.
    """
    table = pivot_table(prints, pivots)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    first, free = table[:, 0], np.ones(len(prints), bool)
    a, b = [], []
    for start in range(len(prints)):
        if not free[start]:
            continue
        free[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            lo, hi = np.searchsorted(first, first[i] - k, "left"), np.searchsorted(first, first[i] + k, "right")
            near = lo + np.flatnonzero(free[lo:hi])
            if len(near):
                near = near[np.abs(table[near] - table[i]).max(axis=1) <= k]
                near = near[np.bitwise_count(prints[near] ^ prints[i]) <= k]
                free[near] = False
                stack.extend(near.tolist())
                a.append(np.full(len(near), prints[i]))
                b.append(prints[near])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def fingerprints(texts: pa.Array, words: int = 3) -> np.ndarray:
    """SimHash of each text: XXH64 (seed 42) of word shingles, repeats included; a bit is 1 if over half the hashes have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(pc.ascii_lower(texts).to_pylist()):
        parts = text.encode().split()  # bytes split at space and U+0009..U+000D
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= words:
            hashes.append(digest(joined, SEED))
            counts[i] = 1
            continue
        ends, starts, at = [], [], 0
        for p in parts:
            starts.append(at)
            at += len(p)
            ends.append(at)
            at += 1
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]
        counts[i] = len(parts) - words + 1
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.cumsum(counts[full]) - counts[full]
        sums = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        ones = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _bucket_links(k: int, n_pivots: int):
    pivots = references(n_pivots)

    def found(key: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """key: rows that name the bucket, equal ones together."""
        new = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        begins = np.concatenate([[0], new])
        sizes = np.diff(np.concatenate([begins, [len(prints)]]))
        pairs = begins[sizes == 2]
        x, y = prints[pairs], prints[pairs + 1]
        near = np.abs(pivot_table(x, pivots) - pivot_table(y, pivots)).max(axis=1, initial=0) <= k
        near &= np.bitwise_count(x ^ y) <= k
        a, b = [x[near]], [y[near]]
        for at, n in zip(begins[sizes > 2], sizes[sizes > 2], strict=True):
            p, q = spanning_links(prints[at : at + n], pivots, k)
            a.append(p)
            b.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []  # of the buckets that aren't whole yet
        prints: list[np.ndarray] = []

        def flush(upto: int) -> Iterator[pa.RecordBatch]:
            key, own = np.concatenate(keys), np.concatenate(prints)
            if upto:
                yield from found(key[:upto], own[:upto])
            keys[:], prints[:] = [key[upto:]], [own[upto:]]

        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_columns - 1
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(n)], axis=1)
            keys.append(key)
            prints.append(batch.column(n).to_numpy().view(np.uint64))
            same = np.all(key == key[-1], axis=1)
            if not same.all() or (len(keys) > 1 and (keys[-2][-1] != key[-1]).any()):  # a bucket ended here; the last one may go on
                tail = int(np.argmin(np.append(same[::-1], False)))
                yield from flush(sum(map(len, keys)) - tail)
        if keys:
            yield from flush(sum(map(len, keys)))

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _parts(mask: int, k: int) -> list[int]:
    """The bits outside the mask in k + 1 parts: fingerprints that agree inside it and differ in k bits agree in one part."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in free[len(free) * i // (k + 1) : len(free) * (i + 1) // (k + 1)]) for i in range(k + 1)]


def bucketed(nodes: DataFrame, k: int, large: int = LARGE) -> DataFrame:
    """nodes (fp) → (choice, bits, part, more, fp), so that each pair within k bits shares a bucket of the first four.

    A bucket of over ``large`` fingerprints is split into k + 1 kinds of smaller ones; no pair is lost.
    """
    masks = bucket_masks(k)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits")) for i, m in enumerate(masks)]))
    spread = nodes.select(keys.alias("k"), "fp").select("k.choice", "k.bits", "fp")
    plain = spread.select("choice", "bits", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more"), "fp")
    full = materialise(spread.groupBy("choice", "bits").count().where(F.col("count") > large).select(F.col("choice").alias("c"), F.col("bits").alias("b")), "simhash-large")
    if full.isEmpty():
        return plain
    own = (F.col("choice") == F.col("c")) & (F.col("bits") == F.col("b"))
    cuts = F.element_at(F.array(*[F.array(*[F.lit(_signed(p)).cast("long") for p in _parts(m, k)]) for m in masks]), F.col("choice") + 1)
    split = spread.join(full, own, "left_semi").select("choice", "bits", "fp", F.posexplode(cuts).alias("part", "cut")).select("choice", "bits", "part", F.col("fp").bitwiseAND(F.col("cut")).alias("more"), "fp")
    return plain.join(full, own, "left_anti").unionByName(split)


def fingerprint_links(nodes: DataFrame, k: int = 3, n_pivots: int = 32) -> DataFrame:
    """nodes (fp long, distinct, held in a table) → (a, b): links that connect what chains of at most k differing bits connect."""
    keys = ["choice", "bits", "part", "more"]
    spread = bucketed(nodes, k).repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(tidied(_bucket_links(k, n_pivots)), "a long, b long")


def simhash_groups(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, k: int = 3, n_pivots: int = 32, batch_bytes: int = 2 << 20) -> DataFrame:
    """Per input row: id, fingerprint (16 hex digits), component_id (smallest id that chains of links reach).

    A-Z count as lower case; a text of fewer words than a shingle is one shingle; a null, empty or blank text has
    fingerprint zero and is linked like any other. Repeated rows come back as often as they came; a null id never is the
    smallest unless its component has no other. Other columns don't matter; an empty table gives no rows. Copies share a
    fingerprint and count once in the search, so a group of copies of any size costs one entry.
    """
    if not 0 <= k < BLOCKS:
        raise ValueError(f"k must be from 0 to {BLOCKS - 1}")
    arrow_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), text_array(batch.column(1))
            for a, b in byte_slices(texts, batch_bytes):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(fingerprints(texts.slice(a, b - a), words).view(np.int64))], ["id", "fp"])

    rows = materialise(docs.select(F.col(id_column).alias("id"), F.col(text_column)).mapInArrow(tidied(run), schema), "simhash-rows")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = components(fingerprint_links(nodes.select("fp"), k, n_pivots))
    grouped = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select(F.col("fp").alias("f"), "component_id")
    return rows.join(named, F.col("fp") == F.col("f")).select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, rows: DataFrame, *, text_column: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """Of the numbered rows (row, doc) of docs one of each group of near copies, the first, with the columns of docs.

    Near copies share ``least`` of their word shingles (Jaccard similarity of the sets), directly or through others; see
    near_copies for why the pivot tables then hold distances of shingle sets. Null, empty and blank texts are copies of one
    another; repeated rows and null ids are rows like any other; an empty table gives no rows.
    """
    from snapwarden.llm.near_copies import near_groups  # which itself searches with this module's tables

    groups = near_groups(rows.select("row", F.col(f"doc.`{text_column}`").alias("text")), words=words, least=least)
    return rows.join(groups.where(F.col("row") == F.col("group")).select("row"), "row", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
