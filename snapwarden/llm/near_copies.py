"""Near copies by the Jaccard similarity of word shingles: SimHash with pivot tables, then what lies beyond its bits.

The first candidates are those of operator 7: the SimHash of a text's set of shingles, and the pivot tables' links between
fingerprints that differ in at most BITS bits. Such a pair can't be missed. But pairs at similarity 0.8 differ in about 10 of
64 bits and some in far more; at such distances Hamming distances to references discard nothing, and no choice of bits is
both selective and whole. The others therefore come from a second search. The Jaccard distance is a metric too, so pivot
tables work on it: distances to references are computed once, a pair whose distances to a reference differ by more than
1 - ``least`` can't be a link and is discarded. Whatever either search finds is verified on the shingle sets.

Which sets the second search holds against each other is told by minima of hashes: of BANDS bands with ROWS minima each a pair at
similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS, which at 0.8 misses one pair in 20 million. The first set
of a bucket is its reference. Sets near it are linked to it and need no more tests among themselves; only the others are
held against the rest of the bucket. Before such a pair leaves the join its parity fingerprints are compared: every hash
flips one of PARITY_BITS bits, so the fingerprints' Hamming distance is at most the number of hashes that only one of the
sets has. The bound loses nothing and keeps edits of one text that are near it, but not near each other, from becoming pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapwarden.llm.components import components
from snapwarden.llm.simhash import fingerprint_links
from snapwarden.llm.storage import arrow_batches, materialise, release
from snapwarden.llm.words import byte_slices, text_array, tidied

SEED = 42
#: Differing bits of SimHash fingerprints up to which operator 7's pivot tables find the pairs.
BITS = 3
BANDS, ROWS = 32, 4
#: Bits of a parity fingerprint; beyond some 800 shingles it discards little and pairs are verified instead.
PARITY_BITS = 512
#: Pairs that one task gets of one text that is in many pairs.
SALT_PAIRS = 512


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct XXH64 hashes of each text's word shingles. A-Z count as lower case; a text of fewer words is one shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = []
    for text in pc.ascii_lower(texts).to_pylist():
        parts = text.encode().split()
        joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]).tolist()
        starts = [0, *ends]
        found = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)] if len(parts) > words else [digest(joined, SEED)]
        out.append(np.unique(np.array(found, np.uint64)))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys for each set."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    factors = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    out, mixed = np.zeros((len(sets), BANDS), np.uint64), np.empty_like(flat)
    for j, factor in enumerate(factors):
        np.multiply(flat, factor, out=mixed)  # the hashes are even already, so an odd factor's high bits give an order of its own
        band = out[:, j // ROWS]
        band *= np.uint64(0x9E3779B97F4A7C15)
        band ^= np.minimum.reduceat(mixed, begins)
        band ^= band >> np.uint64(29)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PARITY_BITS / 64 words for each set: a bit is 1 if an odd number of its hashes fall on it."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = (np.concatenate(sets) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = np.bincount(owner * PARITY_BITS + cell, minlength=len(sets) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), PARITY_BITS), axis=1, bitorder="little").view("<u8")


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set: a bit is 1 if over half of the set's hashes have it."""
    out = np.zeros(len(sets), np.uint64)
    for i, own in enumerate(sets):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 14):
            bits = np.unpackbits(own[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _sign(words: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in byte_slices(texts, batch_bytes):
                sets = shingle_sets(texts.slice(a, b - a), words)
                same = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets]
                keys = pa.array(list(band_keys(sets).view(np.int64)), pa.list_(pa.int64()))
                odd = pa.array(list(parities(sets).view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), keys, odd, pa.array(simhashes(sets).view(np.int64))], ["row", "same", "size", "bands", "odd", "fp"])

    return run


def _sets(words: int, batch_bytes: int):
    """(row, text) → (row, set): the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in byte_slices(texts, batch_bytes):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in shingle_sets(texts.slice(a, b - a), words)], pa.binary())], ["row", "set"])

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b) → (a, b, similarity)."""
    for batch in batches:
        pairs = zip(batch.column(2), batch.column(3), strict=True)
        found = [jaccard(*(np.frombuffer(x.as_buffer(), np.uint64) for x in p)) for p in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b), held in a table, with their similarity. A set b that is in many pairs is dealt to several tasks."""
    often = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT_PAIRS).cast("int").alias("salts"))
    right = often.join(sets, F.col("b") == F.col("row")).select(F.col("b").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("rs"), F.col("set").alias("sb"))
    left = pairs.join(often, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    left = left.join(sets, F.col("a") == F.col("row")).select("a", "b", "salt", F.col("set").alias("sa"))
    both = left.join(right, (F.col("b") == F.col("rb")) & (F.col("salt") == F.col("rs"))).select("a", "b", "sa", "sb")
    return both.mapInArrow(tidied(_measure), "a long, b long, similarity double")


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """prints (node, fp), held in a table → pairs (a, b) of nodes, one for each link of a spanning set of what differs in at most BITS bits."""
    firsts = materialise(prints.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    alike = prints.join(firsts, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    end = lambda name: firsts.select(F.col("fp").alias(f"{name}_fp"), F.col("first").alias(f"{name}_node"))
    links = fingerprint_links(firsts.select("fp"), BITS).join(end("x"), F.col("a") == F.col("x_fp")).join(end("y"), F.col("b") == F.col("y_fp"))
    return alike.unionByName(links.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")))


def near_groups(rows: DataFrame, *, words: int = 5, least: float = 0.8, batch_bytes: int = 2 << 20) -> DataFrame:
    """rows (row long, unique; text), held in a table → (row, group): the smallest row that chains of links reach.

    Two rows are linked where their sets of word shingles have a Jaccard similarity of at least ``least``. Rows with equal
    sets count once in the search, so a group of copies of any size costs one entry. A null, empty or blank text is one
    shingle. Every pair of a bucket is linked already, discarded by its distances to the reference or its sizes, or verified.
    """
    arrow_batches(rows.sparkSession)
    texts = rows.select("row", F.col("text").cast("string").alias("text"))
    signed = materialise(texts.mapInArrow(tidied(_sign(words, batch_bytes)), "row long, same binary, size long, bands array<long>, odd array<long>, fp long"), "near-signed")
    nodes = materialise(signed.groupBy("same").agg(F.min("row").alias("node")), "near-nodes")

    prints = materialise(signed.select("row", "fp").join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "fp"), "near-fingerprints")
    alike = materialise(simhash_pairs(prints).distinct(), "near-alike")
    banded = signed.select("row", "size", "bands").join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "size", F.posexplode("bands").alias("band", "key"))
    heads = banded.groupBy("band", "key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialise(banded.join(heads, ["band", "key"]), "near-members")
    wanted = members.select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node"))).select(F.col("node").alias("w")).distinct()
    sets = materialise(texts.join(wanted, F.col("row") == F.col("w"), "left_semi").mapInArrow(tidied(_sets(words, batch_bytes)), "row long, set binary"), "near-sets")
    pairs = materialise(members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(alike).distinct(), "near-pairs")
    measured = materialise(_similarities(pairs, sets), "near-measured")
    near = measured.where(F.col("similarity") >= least - 1e-12).select("a", "b")
    roots = materialise(components(near), "near-roots")

    # Buckets whose sets aren't all connected yet: those not connected to the head against the rest.
    table = measured.select(F.col("a").alias("ma"), F.col("b").alias("mb"), (1 - F.col("similarity")).alias("distance"))
    head_roots = roots.select(F.col("node").alias("hn"), F.col("root").alias("hr"))
    known = members.join(roots.select(F.col("node").alias("rn"), "root"), F.col("node") == F.col("rn"), "left").join(head_roots, F.col("head") == F.col("hn"), "left")
    known = known.select("band", "key", "node", "size", "head", F.coalesce("root", "node").alias("root"), F.coalesce("hr", "head").alias("main"))
    apart = materialise(known.where("root <> main"), "near-apart")
    mixed = known.where("node <> head").join(apart.select("band", "key").distinct(), ["band", "key"], "left_semi")
    parity = signed.select(F.col("row").alias("pn"), "odd")
    placed = lambda d: d.join(table, (F.col("node") == F.col("ma")) & (F.col("head") == F.col("mb"))).join(parity, F.col("node") == F.col("pn"))
    x = placed(apart).select("band", "key", F.col("node").alias("b"), F.col("size").alias("bs"), F.col("root").alias("br"), F.col("distance").alias("bd"), F.col("odd").alias("bo"))
    y = placed(mixed).select("band", "key", F.col("node").alias("a"), F.col("size").alias("as"), F.col("root").alias("ar"), F.col("main").alias("am"), F.col("distance").alias("ad"), F.col("odd").alias("ao"))
    tried = y.join(x, ["band", "key"]).where((F.col("ar") != F.col("br")) & ((F.col("ar") == F.col("am")) | (F.col("a") < F.col("b"))))
    tried = tried.where((F.abs(F.col("ad") - F.col("bd")) <= 1 - least + 1e-9) & (F.least("as", "bs") >= least * F.greatest("as", "bs") - 1e-9))
    # At a similarity s the sets differ in (1 - s) / (1 + s) of their hashes, counted in both.
    apart_bits = sum(F.bit_count(F.col("ao")[i].bitwiseXOR(F.col("bo")[i])) for i in range(PARITY_BITS // 64))
    tried = tried.where(apart_bits * (1 + least) <= (F.col("as") + F.col("bs")) * (1 - least) + 1e-6)
    others = materialise(tried.select("a", "b").distinct(), "near-others")
    more = materialise(_similarities(others, sets), "near-more").where(F.col("similarity") >= least - 1e-12).select("a", "b")
    ends = components(near.unionByName(more))
    out = signed.select("row", "same").join(nodes, "same").join(ends.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("row", F.coalesce("root", "node").alias("group"))
    for part in (members, apart, sets, pairs, others, prints, alike):
        release(part)
    return out
