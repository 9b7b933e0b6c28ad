"""Quality rules, lines first: rules for punctuation, navigation and boilerplate remove lines; a text that loses too much is rejected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.llm.storage import arrow_batches
from snapwarden.llm.words import WORD, byte_slices, text_array, tidied

_words = re.compile(WORD).findall
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "enable javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "sign up for our newsletter", "subscribe to our", "click here to", "skip to content", "back to top",
    "datenschutzerklärung", "alle rechte vorbehalten", "zum newsletter anmelden", "zum seitenanfang", "politique de confidentialité", "tous droits réservés", "inscrivez-vous à notre", "haut de page", "política de privacidad",
    "todos los derechos reservados", "suscríbete a nuestro", "volver arriba",
)
#: Marks that end or part sentences.
MARKS = re.compile("[.!?…:;。！？؟]")


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules. Shares are of a line's words, or of a text's words for max_loss."""

    min_words: int = 50
    max_repeat_percent: int = 50
    symbol_share: float = 0.3
    separators: int = 3
    separator_share: float = 0.15
    shout_words: int = 5
    unmarked_words: int = 20
    repeat_words: int = 8
    distinct_share: float = 0.34
    max_loss: float = 0.6


def line_fault(line: str, words: list[str], seen: bool, rules: LineRules) -> str:
    """The rule that a line with words breaks, or an empty string. seen: an earlier line of the text is equal."""
    n = len(words)
    if seen:
        return "boilerplate"
    bars = line.count("|") + line.count("»") + line.count(" > ")
    if bars >= rules.separators and bars >= rules.separator_share * n:
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.symbol_share * n and n > 1 or line.count("!!") > rules.symbol_share * n and n > 1:
        return "punctuation"
    if n >= rules.shout_words and line.isupper():
        return "punctuation"
    if n >= rules.unmarked_words and not MARKS.search(line):
        return "punctuation"
    if n >= rules.repeat_words and len(set(words)) < rules.distinct_share * n:
        return "boilerplate"
    if n <= 40 and any(p in line.lower() for p in BOILERPLATE):
        return "boilerplate"
    return ""


def examine(text: str, rules: LineRules) -> tuple:
    """Base statistics, verdicts, the words lost and the text without the failed lines."""
    words = _words(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    before: set[str] = set()
    kept, lost, same, faults = [], 0, 0, 0
    for line in text.split("\n"):
        if own := _words(line):
            seen = line in before
            same += seen
            before.add(line)
            if line_fault(line, own, seen, rules):
                lost += len(own)
                faults += 1
                continue
        kept.append(line)
    failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
    keep = not failed and lost <= rules.max_loss * n and n - lost >= rules.min_words / 2
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), same, repeated, failed, keep, faults, lost, "\n".join(kept)


def clean_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_bad_lines, lost_words, clean_text.

    Lines are judged first and removed where they break a rule; a text is rejected where the base statistics fail, where
    over ``max_loss`` of its words went with its lines, or where fewer than half of ``min_words`` are left. A null or empty
    text has no words, fails the base and isn't kept. Null and repeated ids give one row for each input row. Repeated
    lines: the first stays. Other columns don't matter; an empty table gives no rows. Map-only, one text at a time.
    """
    arrow_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "lost_words", "clean_text"]
    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.LongType()] * 2 + [T.StringType()]
    width = len(names) if with_text else len(names) - 1
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), *[T.StructField(a, b) for a, b in zip(names[:width], kinds, strict=False)]])
    arrow = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), text_array(batch.column(1))
            for a, b in byte_slices(texts, 4 << 20):
                rows = [examine(x, rules) for x in texts.slice(a, b - a).to_pylist()]
                columns = [pa.array([r[i] for r in rows], arrow[i]) for i in range(width)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns], [id_column, *names[:width]])

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(tidied(run), schema)
