"""Removal of word passages that stand earlier in the corpus already, by fixed-block anchors (operator 12).

A window is `WINDOW` consecutive words of a document. A window whose words also start earlier (in a document of a smaller
doc_id, or earlier in the same one) is a repeat, and words that a repeat covers go. Repeats are judged on the input.

Reference blocks are the non-overlapping runs of BLOCK words of every document. A window of 2 * BLOCK words or more holds a whole
block wherever it begins, so of two equal windows each holds, at the same place, the words of a block of the other's document:
every rolling run of BLOCK words is a probe, and a pair of equal windows is always among the probes that meet a block.

1. Documents are gathered where they lie into chunks of CHUNK_BYTES of text, in a table bucketed by chunk, so that later
   steps find a chunk's text without a shuffle of texts.
2. A chunk sends its distinct probes (48 bits of a rolling hash, and whether a block begins there) to buckets, as sorted
   differences. A bucket says which probes of which chunks meet a block of another place. No pairs are made.
3. Hits are extended: the windows around a hit are named by 128 bits of hash, and a chunk sends each name once with its
   first place. A name's earliest place is its original; all other windows of candidates are repeats. Consecutive repeats
   make a maximal exact repeat.

48 bits only choose candidates; 128 bits decide (chance of any error in 10^13 windows: about 10^-13). What one name gathers
in a task is a row a chunk, not a row a copy; CHUNK_BYTES can be raised for larger inputs.

Defined cases: null or empty text has no words; fewer than `WINDOW` words lose none; whole texts are used, however long (a very long
one is a chunk of its own); a null doc_id comes before all others; rows that share a doc_id are one document whose texts begin
at the same word, so equal rows take nothing from each other; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, new_path, released, saved, slices, table

WINDOW, BLOCK = 20, 10
#: Bytes of text of a chunk, and of a bucket of chunks; a longer text is a chunk of its own.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Spark's bound on the buckets of a table; beyond it buckets grow, and a task works on its chunks one after the other.
MAX_BUCKETS = 100_000
#: Bytes of text whose probes a bucket of probes gets.
PROBE_BYTES = 2 << 20
_NULL = -(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNKS = "chunk long, ord int, doc_id long, text binary"


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two neighbouring runs as one, in 64 bits."""
    x = a * _M1 + b
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, of the words' hashes; from shorter runs, whose hashes are made once."""
    if k == 1 or len(h) < k:
        return h[: max(len(h) - k + 1, 0)]
    half = k // 2
    left = rolled(h, half)
    right = left if k - half == half else rolled(h, k - half)
    n = len(h) - k + 1
    return paired(left[:n], right[half : half + n])


class Chunk:
    """A chunk's documents in their order, as one row of words."""

    def __init__(self, rows: pa.Table | pa.RecordBatch) -> None:
        order = np.argsort(rows["ord"].to_numpy())
        found = dict(zip(rows["ord"].to_numpy().tolist(), rows["text"].to_pylist(), strict=True))
        self.doc_ids = rows["doc_id"].to_numpy()[order]
        self.words = [found[o].split() for o in sorted(found)]  # at ASCII white space, as bytes have it
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.n = int(self.ends[-1]) if len(self.ends) else 0
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        place = np.empty(self.n, dtype=np.int32)
        for start, end, words in zip(self.starts.tolist(), self.ends.tolist(), self.words, strict=True):
            place[start:end] = np.fromiter(map(known.__getitem__, words), np.int32, end - start)
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), dtype="<u8").reshape(-1, 2)
        self.place, self.both = place, both
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def hashes(self, k: int, half: int = 0) -> np.ndarray:
        """A half of the hashes of the runs of k words from each word on; those that leave a document are there too."""
        if (k, half) not in self.kept:
            self.kept[k, half] = rolled(np.ascontiguousarray(self.both[:, half])[self.place], k)
        return self.kept[k, half]

    def names(self, k: int, at: np.ndarray) -> np.ndarray:
        """128-bit hashes of the runs of k words at some places, as two columns, of the hashes of their halves."""
        first = k // 2
        return np.stack([paired(self.hashes(first, half)[at], self.hashes(k - first, half)[at + first]) for half in (0, 1)], axis=1)

    def whole(self, k: int) -> np.ndarray:
        """Whether the run of k words from each word on stays in its document."""
        inside = np.arange(self.n) <= np.repeat(self.ends, self.sizes) - k
        return inside[: max(self.n - k + 1, 0)]

    def probes(self, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(48-bit keys of runs of `block` words, their places) of the documents that have a window at all."""
        keys = self.hashes(block) >> np.uint64(16)
        at = np.flatnonzero(self.whole(block) & np.repeat(self.sizes >= window, self.sizes)[: len(keys)])
        return keys[at], at

    def candidates(self, hits: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, names) of the windows that hold a run whose key is among hits; names are two columns of 64 bits."""
        keys, at = self.probes(window, block)
        hit = at[_among(keys, hits)]
        edge = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(hit - (window - block), 0), 1)
        np.add.at(edge, hit + 1, -1)
        near = np.flatnonzero((np.cumsum(edge)[: max(self.n - window + 1, 0)] > 0) & self.whole(window))
        return near, self.names(window, near)

    def originals(self, near: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order of candidates by name and place, number of each one's name in it, doc_id and start by candidate)."""
        doc = np.searchsorted(self.ends, near, side="right")
        ids, start = self.doc_ids[doc], near - self.starts[doc]
        by = np.lexsort([start, ids, names[:, 1], names[:, 0]])
        new = np.ones(len(by), dtype=bool)
        new[1:] = (names[by[1:]] != names[by[:-1]]).any(axis=1)
        return by, np.cumsum(new) - 1, ids, start


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array wanted."""
    found = np.zeros(len(keys), dtype=bool)
    if len(wanted):
        some = np.zeros(1 << 20, dtype=bool)  # by the upper 20 of 48 bits: most keys are out at once
        some[(wanted >> np.uint64(28)).astype(np.int64)] = True
        at = np.flatnonzero(some[(keys >> np.uint64(28)).astype(np.int64)])
        found[at] = wanted[np.minimum(np.searchsorted(wanted, keys[at]), len(wanted) - 1)] == keys[at]
    return found


def packed(numbers: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, the bytes of a rank together, so that a shuffle's compression finds the zeros."""
    steps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def _planes(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the bytes of a rank together."""
    return b"".join(np.ascontiguousarray(c).astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _columns(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(n, 8, -1).transpose(0, 2, 1)).view("<i8").reshape(n, -1)


def _cuts(keys: np.ndarray, buckets: int) -> tuple[list[int], np.ndarray]:
    """(buckets that have some of the ascending 48-bit keys, where each begins and the last ends)."""
    bucket = ((keys >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    return bucket[at].tolist(), np.append(at, len(keys))


def chunked(docs: DataFrame, n_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (doc_id, text) as a table (chunk, ord, doc_id, text) bucketed by chunk; its files stay until clear_scratch()."""
    spark = docs.sparkSession
    schema = pa.schema([("chunk", pa.int64()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        chunk, ord_, room = 0, 0, chunk_bytes
        for b in slices(batches):
            sizes = pc.binary_length(b.column(1)).to_pylist()
            chunks, ords = [], []
            for size in sizes:
                if size > room and ord_:
                    chunk, ord_, room = chunk + 1, 0, chunk_bytes
                chunks.append(part + chunk)
                ords.append(ord_)
                ord_, room = ord_ + 1, room - size
            yield batch(schema, [chunks, ords, b.column(0), b.column(1)])

    name, path = f"rankloom_chunks_{uuid.uuid4().hex}", new_path(spark, "chunks")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    buckets = min(max(math.ceil(n_bytes / BUCKET_BYTES), 1), MAX_BUCKETS)
    rows.mapInArrow(run, _CHUNKS).write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)  # resolved: it keeps the buckets and the files, also without a name in the catalog
    spark.sql(f"DROP TABLE {name}")
    return found


def _probes(chunks: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """(bucket, chunk, keys): a chunk's distinct probes by bucket, each key with two bits: found more than once, found where a block begins."""
    out = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        keys, at = chunk.probes(window, block)
        starts = np.repeat(chunk.starts, chunk.sizes)
        marked = np.sort(keys << np.uint64(1) | ((at - starts[at]) % block == 0).astype(np.uint64))
        keys = marked >> np.uint64(1)
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        if not len(first):
            return out.empty_table()
        last = np.append(first[1:], len(keys)) - 1  # of a key's places; one where a block begins is the last
        marked = keys[first] << np.uint64(2) | (last > first).astype(np.uint64) << np.uint64(1) | marked[last] & np.uint64(1)
        names, cuts = _cuts(keys[first], buckets)
        released()
        return pa.Table.from_batches([batch(out, [names, [key[0].as_py()] * len(names), [packed(marked[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]])])

    return chunks.groupBy("chunk").applyInArrow(run, "bucket int, chunk long, keys binary")


def _hits(probes: DataFrame) -> DataFrame:
    """(chunk, keys): the keys of a chunk that meet a block of another place, of a bucket."""
    out = pa.schema([("chunk", pa.int64()), ("keys", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in rows["keys"].to_pylist()]
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        marked = np.concatenate(parts)
        by = np.argsort(marked, kind="stable")
        marked, source = marked[by], source[by]
        keys = marked >> np.uint64(2)
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        sizes = np.diff(np.append(first, len(keys)))
        marks = np.bitwise_or.reduceat(marked & np.uint64(3), first)
        good = np.repeat((marks & np.uint64(1) > 0) & ((sizes > 1) | (marks & np.uint64(2) > 0)), sizes)
        keys, source = keys[good], source[good]
        by = np.argsort(source, kind="stable")
        names, cuts = np.unique(source[by], return_index=True)
        blobs = [packed(keys[by[i:j]]) for i, j in zip(cuts, np.append(cuts[1:], len(by)), strict=True)]
        return pa.Table.from_batches([batch(out, [rows["chunk"].take(pa.array(names)).combine_chunks(), blobs])])

    return probes.groupBy("bucket").applyInArrow(run, "chunk long, keys binary")


def _gathered(hits: pa.Table) -> np.ndarray:
    parts = [unpacked(x) for x in hits["keys"].to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def _candidates(chunks: DataFrame, hits: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """(bucket, chunk, n, blob): names of a chunk's candidates by bucket, each once with its first place and number."""
    out = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])

    def run(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows or not found.num_rows:
            return out.empty_table()
        chunk = Chunk(rows)
        near, names = chunk.candidates(_gathered(found), window, block)
        by, number, ids, start = chunk.originals(near, names)
        if not len(by):
            return out.empty_table()
        at = by[np.flatnonzero(np.diff(number, prepend=-1))]
        which, cuts = _cuts(names[at, 0] >> np.uint64(16), buckets)
        columns = [names[at, 0].view("<i8"), names[at, 1].view("<i8"), ids[at], start[at], np.arange(len(at))]
        released()
        return pa.Table.from_batches([batch(out, [which, [key[0].as_py()] * len(which), [_planes([c[i:j] for c in columns]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]])])

    return chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(run, "bucket int, chunk long, blob binary")


def _originals(candidates: DataFrame) -> DataFrame:
    """(chunk, numbers): the numbers of a chunk's names whose first place there is the first of all, of a bucket."""
    out = pa.schema([("chunk", pa.int64()), ("numbers", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        parts = [_columns(x, 5) for x in rows["blob"].to_pylist()]
        source = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        high, low, ids, start, number = np.concatenate(parts, axis=1)
        by = np.lexsort([start, ids, low, high])
        new = np.ones(len(by), dtype=bool)
        new[1:] = (high[by[1:]] != high[by[:-1]]) | (low[by[1:]] != low[by[:-1]])
        least = by[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each row's name, in this order
        first = by[(ids[by] == ids[least]) & (start[by] == start[least])]
        first = first[np.lexsort([number[first], source[first]])]
        names, cuts = np.unique(source[first], return_index=True)
        blobs = [packed(number[first[i:j]].astype(np.uint64)) for i, j in zip(cuts, np.append(cuts[1:], len(first)), strict=True)]
        return pa.Table.from_batches([batch(out, [rows["chunk"].take(pa.array(names)).combine_chunks(), blobs])])

    return candidates.groupBy("bucket").applyInArrow(run, "chunk long, numbers binary")


def _kept(chunks: DataFrame, marks: DataFrame, window: int, block: int) -> DataFrame:
    """(doc_id, n_words, removed, kept) of each document; marks has a chunk's hits (keys) and originals (numbers)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", span), ("kept", pa.string())])

    def run(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        chunk = Chunk(rows)
        edge = np.zeros(chunk.n + 1, dtype=np.int64)
        if found.num_rows:
            keyed = found.filter(found["keys"].is_valid())
            near, names = chunk.candidates(_gathered(keyed), window, block)
            by, number, ids, start = chunk.originals(near, names)
            first = np.zeros(int(number[-1]) + 1 if len(by) else 0, dtype=bool)
            for blob in found["numbers"].drop_null().to_pylist():
                first[unpacked(blob).astype(np.int64)] = True
            # Of an original's name, all candidates at the same place of the same doc_id are the original.
            lead = by[np.flatnonzero(np.diff(number, prepend=-1))][number] if len(by) else by
            repeats = near[by[~(first[number] & (ids[by] == ids[lead]) & (start[by] == start[lead]))]]
            np.add.at(edge, repeats, 1)
            np.add.at(edge, repeats + window, -1)
        gone = np.cumsum(edge)[: chunk.n] > 0
        spans, kept = [], []
        for s, e, words in zip(chunk.starts.tolist(), chunk.ends.tolist(), chunk.words, strict=True):
            mask = gone[s:e]
            if not mask.any():
                spans.append([])
                kept.append(b" ".join(words).decode())
                continue
            turns = np.flatnonzero(np.diff(mask, prepend=False, append=False))
            spans.append([{"start": i, "length": j - i} for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)])
            kept.append(b" ".join([words[i] for i in np.flatnonzero(~mask).tolist()]).decode())
        ids = [None if i == _NULL else i for i in chunk.doc_ids.tolist()]
        result = pa.Table.from_batches([batch(out, [ids, chunk.sizes, spans, kept])])
        released()
        return result

    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, "doc_id long, n_words long, removed array<struct<start: long, length: long>>, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES, probe_bytes: int = PROBE_BYTES) -> DataFrame:
    """(doc_id, n_words, removed, kept) of each row of docs (doc_id, text).

    removed: array<struct(start, length)>, the maximal stretches of words that go. kept: the other words, joined by blanks.
    """
    if window < 2 or not 1 <= block <= (window + 1) // 2:
        raise ValueError("a window has to hold a whole block wherever it begins: 2 * block - 1 <= window")
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select("doc_id", "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(math.ceil(n_bytes / probe_bytes), 1)
    chunks = chunked(docs, n_bytes, chunk_bytes)
    hits = saved(_hits(_probes(chunks, window, block, buckets)), "hits")
    first = saved(_originals(_candidates(chunks, hits, window, block, buckets)), "originals")
    marks = hits.withColumn("numbers", F.lit(None).cast("binary")).unionByName(first.withColumn("keys", F.lit(None).cast("binary")))
    return _kept(chunks, marks, window, block)


def op12_substring_dedup(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS j FROM rep) GROUP BY doc_id),
every AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS j FROM d JOIN gone USING (doc_id)),
kept AS (SELECT e.doc_id, coalesce(string_agg(w[j], ' ' ORDER BY j) FILTER (NOT list_contains(js, j)), '') AS text FROM every e JOIN gone USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
