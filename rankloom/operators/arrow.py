"""Bounds on what Python workers hold (bytes of an Arrow batch, and of a slice of it that becomes Python objects), and words of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch where the session still has Spark's default, and bytes and rows of a slice. A row may exceed either.
BATCH_BYTES, SLICE_BYTES, SLICE_ROWS = 8 << 20, 1 << 20, 64
#: Bytes that end a word (ASCII white space and hyphens), and white space beyond ASCII.
_CUTS = np.isin(np.arange(256), [*range(9, 14), 32, 45])
_WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CONF, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def arrow_bytes(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that go to Python workers, unless the session has its own bound."""
    if spark.conf.get(_CONF).lower().removesuffix("b") in ("64m", str(_SPARK_DEFAULT)):
        spark.conf.set(_CONF, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices (no copies) of at most `rows` rows and `size` bytes of the text column; a row over it is a slice of its own."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(max(int(np.searchsorted(ends, before + size, side="right")), at + 1), at + rows)
            yield b.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the letters of each word of texts that functions.text.lowered() gave: those of tokens(), without an object a word."""
    texts = texts.cast(pa.string())
    if not pc.all(pc.string_is_ascii(texts), min_count=0).as_py():
        texts = pc.replace_substring_regex(texts, pattern=_WIDE_SPACE, replacement=" ")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets or bytes(4), dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kept = ~_CUTS[data]
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    rows = ends[:-1][ends[:-1] < len(data)]
    begins[rows] = kept[rows]  # a row's first word doesn't go on from the row before
    row = np.searchsorted(ends, np.flatnonzero(begins), side="right") - 1
    starts = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept)).astype(np.int32)
    return row, pa.StringArray.from_buffers(len(row), pa.py_buffer(starts), pa.py_buffer(data[kept]))


def letter_counts(texts: pa.Array, letters: str) -> pa.Array:
    """A list a text of how often it has each letter of one byte; texts without nulls, which are read a byte at a time, and held one text's numbers each."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets or bytes(4), dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data, codes = np.frombuffer(data or b"", dtype=np.uint8), np.frombuffer(letters.encode(), dtype=np.uint8)
    found = [np.bincount(data[a:b], minlength=256)[codes] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    values = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(codes), pa.int32()), pa.array(values))
