"""Token counts: Arrow batches in, lengths only out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.llm.storage import arrow_batches
from snapwarden.llm.tokens import default_path, encoder
from snapwarden.llm.words import byte_slices, text_array, tidied


def count_tokens(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, limit: int = 2048, batch_bytes: int = 2 << 20, piece_chars: int = 4 << 20) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Null and repeated ids are kept, one row for each
    input row; other columns are ignored, whatever their names. An empty table gives an empty result. Each Arrow batch is
    encoded in slices of about ``batch_bytes``; a text of over ``piece_chars`` characters is cut between words, where no
    token can span, and its counts are added. Map-only: no shuffle, memory bounded by the batch and the word memory.
    """
    arrow_batches(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), text_array(batch.column(1))
            for a, b in byte_slices(texts, batch_bytes):
                part = texts.slice(a, b - a)
                n = own.counts(part, piece_chars)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pc.cast(pc.binary_length(part), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [id_column, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(tidied(run), schema)
