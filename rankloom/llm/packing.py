"""Cost-balanced packing of documents into fixed-length training sequences (operator 4).

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention stays inside a piece). Each task
streams its documents: whole multiples of the sequence length become sequences of their own, the
remainders are gathered into a window of bounded tokens. A full window opens as many sequences as its
tokens need and assigns its pieces in descending length, each to the sequence of lowest cost that has
room for it; a piece that fits nowhere is cut, and fills the emptiest sequences. So every window but
the last of a task leaves no padding: its sequences are all full, and what is over (less than one
sequence) goes to the next window. What a task's last window lacks, under one sequence, is padding, spread over
its sequences.

Nothing is shuffled and no state is shared: a lost task is computed again from its own input alone,
with the same result. sequence_id is the task's partition number times 2^32 plus a count.

Defined cases: null or empty text has no ids but the end id; very long texts are encoded whole and cut into full
sequences and a remainder; documents are packed in stored order and rows that repeat, or have a null doc_id, are packed
as rows of their own; ties between pieces of a length go to the first; an empty table gives no rows; other columns are
ignored, whatever their names. Ids have the width that the vocabulary asks for, 16 or 32 bits.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rankloom.llm.common import arrow_batches, batch, slices, table, values
from rankloom.llm.tokens import encoder, id_type, vocabulary, with_end

LENGTH = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens gathered before a window is packed: 256 sequences.
WINDOW = 256 * LENGTH
#: Bytes of text encoded at once, and words remembered: fewer than for files, as a pipeline's executors hold more beside them.
BLOCK, CACHE_WORDS = 4 << 20, 300_000


def cost(n: int) -> float:
    """Estimated cost of a piece of n tokens."""
    return LINEAR * n + QUADRATIC * n * n


def assign(sizes: list[int], length: int, bins: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (document, start, n) of each of `bins` sequences of `length`, which have room for all.

    Documents come in descending size (ties: in order), each to the sequence of lowest cost with room
    (ties: the first). One that fits nowhere whole is cut over the sequences with the most room.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    room = [length] * bins
    open_ = [(0.0, b) for b in range(bins)]  # a heap by cost; full sequences leave it
    total = [0.0] * bins

    def put(b: int, doc: int, start: int, n: int) -> None:
        out[b].append((doc, start, n))
        room[b] -= n
        total[b] += cost(n)

    for doc in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n, start = sizes[doc], 0
        passed = []
        while open_ and room[open_[0][1]] < n:
            passed.append(heapq.heappop(open_))
        if open_:
            b = heapq.heappop(open_)[1]
            put(b, doc, 0, n)
            if room[b]:
                heapq.heappush(open_, (total[b], b))
        else:
            passed.sort(key=lambda e: (-room[e[1]], e[1]))
            while n:
                b = passed.pop(0)[1]
                part = min(n, room[b])
                put(b, doc, start, part)
                start, n = start + part, n - part
                if room[b]:
                    passed.append((total[b], b))
        for e in passed:
            heapq.heappush(open_, e)
    return out


class Packer:
    """Packs a stream of (row, n) and yields (row, start, n, sequence, offset); sequences count from 0."""

    def __init__(self, length: int = LENGTH, window: int = WINDOW) -> None:
        self.length, self.window = length, max(window, length)
        self.held: list[tuple[object, int, int]] = []  # (row, start, n), n < length
        self.tokens = 0
        self.sequences = 0

    def add(self, row: object, n: int) -> Iterator[tuple]:
        full = n // self.length
        for k in range(full):
            yield row, k * self.length, self.length, self.sequences, 0
            self.sequences += 1
        if rest := n - full * self.length:
            self.held.append((row, full * self.length, rest))
            self.tokens += rest
        if self.tokens >= self.window:
            yield from self._pack(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._pack(last=True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        over: list[tuple[object, int, int]] = []
        if not last and (extra := self.tokens % self.length):
            # The last pieces that don't fill a sequence wait for the next window.
            while extra:
                row, start, n = self.held.pop()
                part = min(n, extra)
                over.append((row, start + n - part, part))
                if n > part:
                    self.held.append((row, start, n - part))
                extra -= part
        now, self.held = self.held, over[::-1]
        bins = -(-sum(n for _, _, n in now) // self.length)
        for pieces in assign([n for _, _, n in now], self.length, bins):
            offset = 0
            for doc, start, n in pieces:
                row, base, _ = now[doc]
                yield row, base + start, n, self.sequences, offset
                offset += n
            self.sequences += 1
        self.tokens = sum(n for _, _, n in self.held)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OUT = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def pack(df: DataFrame, vocab: str, end_id: int = END_ID, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: str = "text") -> DataFrame:
    """One row a piece (see the contract of op4); with_ids adds the piece's token ids as an array. added: see tokens.Encoder."""
    schema = pa.schema([*_OUT, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, coder = Packer(length, window), encoder(vocab, "word", added, CACHE_WORDS)
        kind = id_type(max(coder.size, end_id + 1))
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(pieces: Iterator[tuple]) -> None:
            for (doc, ids), start, n, seq, offset in pieces:
                part = ids[start : start + n]
                rows.append((doc, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), base + seq, offset, *([part.astype(np.int32)] if with_ids else [])))

        def out() -> pa.RecordBatch:
            b = batch(schema, list(zip(*rows, strict=True)))
            rows.clear()
            return b

        for b in slices(batches, BLOCK):
            for doc, ids in zip(values(b.column(0)), with_end(*coder.encode_many(b.column(1)), end_id, kind), strict=True):
                emit(packer.add((doc, ids), len(ids)))
                if len(rows) >= 1024:
                    yield out()
        emit(packer.finish())
        if rows:
            yield out()

    arrow_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def op4_cost_balanced_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), added="ids")
