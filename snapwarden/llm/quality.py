"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Their votes, counted by pattern over all
documents, go to an expectation-maximisation that estimates each labeller's accuracy for both classes and from it the
posterior of every pattern. On a bounded sample of documents the posteriors train a linear scorer over hashed features
(words and binned statistics); the scorer decides on all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.llm.storage import arrow_batches, materialise
from snapwarden.llm.words import WORD, byte_slices, split_words, text_array, tidied

_words = re.compile(WORD).findall
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is it that was for on are as with be by at this from or an have not"
    " der die das und in zu den von ist mit sich des auf für im dem nicht ein eine als"
    " le la les de des et un une que qui en est pour dans du au sur par avec"
    " el los las del y en que un una por con para es se no".split()
)
LABELLERS = ("symbols", "separators", "capitals", "repeats", "stop_words", "variety", "exclamations", "word_length")
#: For each labeller: bad at or beyond the first value, good at or beyond the second; the sign tells which way is worse.
LIMITS = {"symbols": (1, 0.2, 0.03), "separators": (1, 0.15, 0.01), "capitals": (1, 0.5, 0.1), "repeats": (1, 0.25, 0.03), "stop_words": (-1, 0.05, 0.12), "variety": (-1, 0.2, 0.35), "exclamations": (1, 0.2, 0.02), "word_length": (1, 9.0, 7.0)}
#: Fewest words on which a labeller votes, where one word is too few.
LEAST = {"stop_words": 30, "variety": 20, "word_length": 10}
VARIETY_WORDS = 200
BAD, GOOD, NONE = 0, 1, 2


def statistics(text: str) -> tuple[int, ...] | tuple:
    """Number of words, and one value for each labeller."""
    words = _words(text)
    n = len(words)
    if not n:
        return 0, *[0.0] * len(LABELLERS)
    stops = sum(map(STOP_WORDS.__contains__, map(str.lower, words)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capital = sum(map(str.isupper, words))
    symbols = sum(map(text.count, "#*$%&<>"))
    return n, symbols / n, text.count("|") / n, capital / n, same / n, stops / n, variety(words), text.count("!!") / n, sum(map(len, words)) / n


def variety(words: list[str]) -> float:
    """Mean share of distinct words over consecutive windows of about VARIETY_WORDS; the share falls with length, so like numbers are compared."""
    parts = max(1, len(words) // VARIETY_WORDS)
    cuts = [len(words) * i // parts for i in range(parts + 1)]
    return sum(len(set(words[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)) / parts


def votes(stats: tuple) -> int:
    """The labellers' votes as digits of base 3. A labeller of shares that need a longer text doesn't vote on a short one."""
    out = 0
    for name, value in zip(LABELLERS, stats[1:], strict=True):
        sign, bad, good = LIMITS[name]
        vote = NONE if stats[0] < LEAST.get(name, 1) else BAD if sign * value >= sign * bad else GOOD if sign * value <= sign * good else NONE
        out = 3 * out + vote
    return out


def unpack(pattern: int) -> list[int]:
    digits = []
    for _ in LABELLERS:
        pattern, d = divmod(pattern, 3)
        digits.append(d)
    return digits[::-1]


@dataclass
class LabelModel:
    """prior of good; table[class][labeller][vote], of the votes cast; posterior of good by pattern."""

    prior: float
    table: np.ndarray
    posterior: dict[int, float]

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        right = (1 - self.prior) * self.table[0, :, BAD] + self.prior * self.table[1, :, GOOD]
        return {n: float(x) for n, x in zip(LABELLERS, right, strict=True)}


def fit_labels(counts: dict[int, int], rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation on vote patterns (at most 3 to the number of labellers), weighted by their counts. Starts from the majority with doubt on any bad vote."""
    patterns = np.array([unpack(p) for p in counts] or [[NONE] * len(LABELLERS)])
    weight = np.array([*counts.values()] or [0], float)
    bad, good = (patterns == BAD).sum(axis=1), (patterns == GOOD).sum(axis=1)
    belief = np.where(bad + good > 0, (good + 0.5) / (good + 3.0 * bad + 1.0), 0.5)
    prior, table = 0.5, np.ones((2, len(LABELLERS), 3))
    for _ in range(rounds):
        by = np.stack([(1 - belief) * weight, belief * weight])
        prior = float((by[1].sum() + smooth) / (by.sum() + 2 * smooth))
        cast = by @ (patterns != NONE)
        for v in (BAD, GOOD):  # a labeller that says nothing is no evidence
            table[:, :, v] = (by @ (patterns == v) + smooth) / (cast + 2 * smooth)
        logs = np.log(table[:, np.arange(len(LABELLERS))[None, :], patterns]).sum(axis=2)
        gap = np.clip(logs[1] - logs[0] + np.log(prior / (1 - prior)), -60, 60)
        new = 1 / (1 + np.exp(-gap))
        if np.abs(new - belief).max() < 1e-9:
            belief = new
            break
        belief = new
    return LabelModel(prior, table, dict(zip(counts, belief.tolist(), strict=False)))


def _bins(stats: tuple) -> list[str]:
    """Statistics as words: the value of each labeller in steps."""
    return [f"\x00{name}={min(int(value * (1 if name == 'word_length' else 20)), 30)}" for name, value in zip(LABELLERS, stats[1:], strict=True)]


def _bucket(word: str, dims: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word) % dims


def hashed(text: str, stats: tuple, dims: int) -> tuple[list[int], list[float]]:
    """Features of one text: hashed words with their share of all words, and hashed bins with 1."""
    found: dict[int, float] = {}
    for w in _words(text):
        k = _bucket(w, dims)
        found[k] = found.get(k, 0.0) + 1 / stats[0]
    for b in _bins(stats):
        k = _bucket(b, dims)
        found[k] = found.get(k, 0.0) + 1.0
    return [*found], [*found.values()]


def fit_scorer(rows: list[tuple[list[int], list[float], float]], dims: int, rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch AdaGrad."""
    weights, bias = np.zeros(dims), 0.0
    if not rows:
        return weights, bias
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    column, value = np.concatenate([np.asarray(r[0], np.int64) for r in rows]), np.concatenate([np.asarray(r[1], float) for r in rows])
    want = np.array([r[2] for r in rows])
    seen, seen_bias = np.full(dims, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(at, value * weights[column], len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - want) / len(rows)
        slope, slope_bias = np.bincount(column, value * err[at], dims) + decay * weights, float(err.sum())
        seen += slope**2
        seen_bias += slope_bias**2
        weights -= rate * slope / np.sqrt(seen)
        bias -= rate * slope_bias / np.sqrt(seen_bias)
    return weights, bias


def classify(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", dims: int = 1 << 14, sample: int = 4000, threshold: float = 0.5, batch_bytes: int = 2 << 20, keep_columns: bool = False) -> DataFrame:
    """Per input row: id, n_words, posterior (of the labellers' pattern), score (of the scorer), kept (score >= threshold).

    ``sample`` bounds the documents that train the scorer: about so many by a hash of id and text, at most twice as many.
    The vote counts cover all documents. A null, empty or blank text has score 0 and isn't kept. Null and repeated ids give
    one row per input row; an empty table gives no rows. ``keep_columns``: the columns of docs come first, as c0, c1 and so
    on, so that none clashes with those of the classifier.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = docs.schema[id_column].dataType
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, int] = {}
            for text in text_array(batch.column(0)).to_pylist():
                p = votes(statistics(text))
                found[p] = found.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), pa.array([*found.values()], pa.int64())], ["pattern", "n"])

    counted = base.select("text").mapInArrow(tidied(vote), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in sorted(counted)}
    model, total = fit_labels(counts), sum(counts.values())

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in text_array(batch.column(0)).to_pylist():
                stats = statistics(text)
                if stats[0]:
                    rows.append((*hashed(text, stats, dims), model.posterior.get(votes(stats), model.prior)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.float64())], ["columns", "shares", "label"])

    part = min(1.0, sample / max(1, total))
    chosen = base.where(F.pmod(F.xxhash64("id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(1 << 30)) < int(part * (1 << 30))).select("text").limit(2 * sample)
    got = chosen.mapInArrow(tidied(train), "columns array<int>, shares array<float>, label double").toArrow()
    rows = list(zip(*[got[c].to_pylist() for c in ("columns", "shares", "label")], strict=True))
    weights, bias = fit_scorer(sorted(rows, key=lambda r: (r[2], len(r[0]), r[0][:8])), dims)
    weights = weights.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}

        def weight(word: str) -> float:
            w = memory.get(word)
            if w is None:
                w = float(weights[_bucket(word, dims)])
                if len(memory) < 300_000:
                    memory[word] = w
            return w

        for batch in batches:
            all_texts = text_array(batch.column(1))
            for a, b in byte_slices(all_texts, batch_bytes):
                texts = all_texts.slice(a, b - a)
                stats = [statistics(t) for t in texts.to_pylist()]
                flat, offsets = split_words(texts)
                coded = flat.dictionary_encode()
                by_word = np.fromiter(map(weight, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), float, len(coded.dictionary))
                sums = np.concatenate([[0.0], np.cumsum(by_word[coded.indices.to_numpy()])]) if len(flat) else np.zeros(1)
                n = np.array([s[0] for s in stats])
                z = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1) + bias + np.array([sum(weight(x) for x in _bins(s)) for s in stats])
                p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                posterior = [model.posterior.get(votes(s), model.prior) if s[0] else 0.0 for s in stats]
                own = [batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns)]
                head = [*own] if keep_columns else [batch.column(0).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(n, pa.int64()), pa.array(posterior, pa.float64()), pa.array(p, pa.float64()), pa.array((p >= threshold) & (n > 0))], names)

    extra = [T.StructField("n_words", T.LongType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    if keep_columns:
        names = [f"c{i}" for i in range(len(docs.columns))] + [f.name for f in extra]
        named = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)] + extra)
        shown = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
        return shown.mapInArrow(tidied(score), named)
    names = [id_column, *[f.name for f in extra]]
    return base.mapInArrow(tidied(score), T.StructType([T.StructField(id_column, kind), *extra]))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that classify keeps, with the columns of docs, whatever they are called. Rows are judged one by one, so repeated rows and null ids stay as they came; null, empty and blank texts go."""
    found = classify(docs, keep_columns=True, **options).where("kept")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
