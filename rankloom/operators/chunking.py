"""Chunking along section structure, by Arrow functions within the row: offsets of headers and paragraphs, then one step a piece.

Headers and paragraphs are found by one pass of a pattern over a text. Greedy packing goes over prefix sums of the
paragraphs' lengths: where a piece ends is found by bisection, so that a text costs time in proportion to its length and
pieces, however many paragraphs it has. Nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import slug
from rankloom.operators.arrow import arrow_bytes, slices

MAX_CHARS, OVERLAP = 800, 100
_HEADER = re.compile(r"^(#{1,6})[^\S\n]+(.*)$", re.M)
_GAP = re.compile(r"\n\s*\n")
#: Rows of a batch that become Python strings at once.
_ROWS = 64
_BLOCKS = pa.list_(pa.struct([("block", pa.int32()), ("section", pa.string()), ("body", pa.string())]))
_TEXTS = pa.list_(pa.string())


def checked(max_chars: int, overlap: int) -> None:
    if max_chars < 1 or overlap < 0 or overlap >= max_chars:
        raise ValueError("chunking needs 0 <= overlap < max_chars")


def sections_of(text: str) -> list[tuple[int, str, str]]:
    """(block, section, body) of a text's header blocks that aren't empty.

    A level-1 header is dropped and starts nothing. A level-2 header, or the first deeper one before any, is a root;
    deeper ones are its children. Blocks are numbered by their header, from 1; 0 is what stands before any.
    """
    out, lines, root, section, block, at = [], [], None, "Document", 0, 0

    def close(end: int) -> None:
        if at <= end:  # else not even an empty line is between two headers
            lines.append(text[at:end])
        if body := "\n".join(lines).strip():
            out.append((block, section, body))

    for header in _HEADER.finditer(text):
        level = header.end(1) - header.start(1)
        if level == 1:
            if at < header.start():
                lines.append(text[at : header.start() - 1])
        else:
            close(header.start() - 1)
            title, lines, block = header[2].strip(), [], block + 1
            if level == 2 or root is None:
                root = section = title
            else:
                section = f"{root} > {title}"
        at = header.end() + 1
    close(len(text))
    return out


def windows_of(text: str, max_chars: int, overlap: int) -> list[str]:
    """Windows of max_chars with an overlap while more than max_chars are left; the rest is the last piece."""
    step = max_chars - overlap
    n = max(0, -(-(len(text) - max_chars) // step))
    return [*(text[i * step : i * step + max_chars] for i in range(n)), text[n * step :]]


def pieces_of(body: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs of an oversized body packed greedily (two more characters count for each); one that is too long is cut into windows."""
    if len(body) <= max_chars:
        return [body]
    parts = [p for p in (x.strip() for x in _GAP.split(body)) if p]
    sums = [0, *accumulate(len(p) + 2 for p in parts)]  # of the paragraphs before each
    out, at = [], 0
    while at < len(parts):
        *cut, rest = windows_of(parts[at], max_chars, overlap) if len(parts[at]) > max_chars else [parts[at]]
        out += cut
        if cut and at + 1 < len(parts) and len(rest) + len(parts[at + 1]) + 2 <= max_chars:
            rest = rest.lstrip()  # only what is packed with more loses the blanks that a window left
        end = bisect_right(sums, max_chars - len(rest) + sums[at + 1], lo=at + 1) - 1
        out.append("\n\n".join([rest, *parts[at + 1 : end]]) if end > at + 1 else rest)
        at = max(end, at + 1)
    return out


def _mapped(column: pa.Array, f, kind: pa.DataType) -> pa.Array:
    """f of each text (null: null), some rows at a time."""
    texts = lambda at: column.slice(at, _ROWS).to_pylist()
    done = [pa.array([None if x is None else f(x) for x in texts(at)], type=kind) for at in range(0, len(column), _ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], type=kind)


def blocks(text: Column) -> Column:
    """array<struct(block, section, body)> of a text; see sections_of()."""

    @F.arrow_udf("array<struct<block: int, section: string, body: string>>")
    def cut(texts: pa.Array) -> pa.Array:
        return _mapped(texts, lambda x: [{"block": n, "section": s, "body": b} for n, s, b in sections_of(x)], _BLOCKS)

    return cut(text)


def _exploded(documents: DataFrame, id_col: str, text_col: str, f: Callable[[str], list[tuple]], fields: dict[str, pa.DataType]) -> DataFrame:
    """A row (doc_id, fields) for each tuple that f gives of a row's text (null: none). Only a slice of a batch is held as Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            at, found = [], []
            for n, text in enumerate(b.column(1).to_pylist()):
                if text is not None:
                    found += f(text)
                    at += [n] * (len(found) - len(at))
            if found:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *columns], names=["doc_id", *fields])

    arrow_bytes(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    types = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *(f"{name} {types[kind]}" for name, kind in fields.items())])
    return rows.mapInArrow(run, schema)


def header_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block, section, body) for each header block of each row that isn't empty; see sections_of(). Nothing is shuffled."""
    return _exploded(documents, id_col, text_col, sections_of, {"block": pa.int32(), "section": pa.string(), "body": pa.string()})


def hard_pieces(text: Column, max_chars: int, overlap: int) -> Column:
    """array<string>; see windows_of()."""
    checked(max_chars, overlap)

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return _mapped(texts, lambda x: windows_of(x, max_chars, overlap), _TEXTS)

    return cut(text)


def pieces(body: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """array<string>; see pieces_of()."""
    checked(max_chars, overlap)

    @F.arrow_udf("array<string>")
    def cut(bodies: pa.Array) -> pa.Array:
        return _mapped(bodies, lambda x: pieces_of(x, max_chars, overlap), _TEXTS)

    return cut(body)


def chunks(documents: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, doc_id, chunk_ix, section, text); chunk_ix counts from 1 over a row. Nothing is shuffled."""
    checked(max_chars, overlap)

    def cut(text: str) -> list[tuple]:
        every = [(section, piece) for _, section, body in sections_of(text) for piece in pieces_of(body, max_chars, overlap)]
        return [(n, *piece) for n, piece in enumerate(every, 1)]

    rows = _exploded(documents, id_col, text_col, cut, {"chunk_ix": pa.int64(), "section": pa.string(), "text": pa.string()})
    chunk_id = F.concat_ws("-", F.col("doc_id").cast("string"), slug("section"), F.col("chunk_ix").cast("string"))
    return rows.select(chunk_id.alias("chunk_id"), "doc_id", "chunk_ix", "section", "text")
