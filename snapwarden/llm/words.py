"""Vectorised words of Arrow text arrays. A word is a run of characters other than space and U+0009..U+000D."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: As a Java and Python regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column, "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the texts' offsets into them."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():  # white space at either end leaves empty strings
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


def byte_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer text is a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cuts of a long text into pieces of about limit characters, only where one white-space character stands between words."""
    if len(text) <= limit:
        return [text]
    pieces, start = [], 0
    while len(text) - start > limit:
        cut = start + limit
        while cut < len(text) and text[cut] not in " \t\n\v\f\r":
            cut += 1
        pieces.append(text[start:cut])
        start = cut
    return [*pieces, text[start:]]


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the worker gives its free memory back: workers live on beside the executor's heap."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
