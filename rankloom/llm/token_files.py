"""Token ids in frequency-ranked, byte-aligned variable-length files (operator 5).

Ids are replaced by their rank by frequency over all documents (ties: the smaller id first), so that
frequent ids take one byte. A shard keeps 2-bit byte counts apart from the data: a control byte holds
the byte counts (1 to 4) of four ranks, the data bytes are little-endian. Decoding looks each control
byte up in tables of 256 rows and gathers the bytes with numpy, without a loop over ids.

A shard is one binary value: magic, version, number of documents and of ids, the documents' ids and
sizes, then control bytes and data bytes, with a checksum. Shards are rows of a Parquet table in
ascending doc_id order (part, k, first, n_docs, n_tokens, blob), written by Spark, so they can lie in any
store that Spark writes to. first counts the part's ids before a shard, so that a reader needs only the sums
of parts, of which there are as many as write tasks. The ids by rank lie in a folder `_ranks` beside the shards, so
that a later session reads the files by their path alone.

Defined cases: null or empty text has the end id alone; very long texts are encoded whole (a shard ends with the
document that fills it); a null doc_id sorts first; repeated doc_ids stay rows of their own, next to each other, in order
of a hash of their ids; ties in frequency go to the smaller id; an empty table gives empty files; other columns are
ignored, whatever their names. Ids have the width that the vocabulary asks for, 16 or 32 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, dropped, new_path, saved, slices, table, values
from rankloom.llm.tokens import BLOCK_BYTES, encoder, id_type, vocabulary

END_ID = 0
MAGIC = b"RVB1"
#: Tokens of one shard, about; a shard ends with the document that reaches it.
SHARD_TOKENS = 1 << 21
_SHARDS = "part long, k long, first long, n_docs long, n_tokens long, blob binary"
_RANKS, _RANK_FOLDER = "version int, n_ids long, crc32 long, ids binary", "_ranks"
_NULL = -(1 << 63)  # stands for a null doc_id

#: For each control byte: the byte counts of its four values.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values; control has a byte for each four, zero-filled."""
    v = np.ascontiguousarray(values, dtype="<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    quads[: len(v)] = extra
    q = quads.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    stops = np.cumsum(extra, dtype=np.int64) + np.arange(1, len(v) + 1)
    starts = stops - extra - 1
    data = np.empty(int(stops[-1]) if len(v) else 0, dtype=np.uint8)
    data[starts] = v.astype(np.uint8)
    longer = np.flatnonzero(extra)
    for k in range(1, 4):
        data[starts[longer] + k] = (v[longer] >> np.uint32(8 * k)).astype(np.uint8)
        longer = longer[extra[longer] > k]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of encode_values(), by table lookup."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    found = np.frombuffer(data, np.uint8)
    words = found[starts].astype(np.uint32)
    longer = np.flatnonzero(sizes > 1)
    for k in range(1, 4):
        words[longer] |= found[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
        longer = longer[sizes[longer] > k + 1]
    return words


def write_shard(doc_ids: list[int], sizes: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    head = struct.pack("<4sIQQQ", MAGIC, 1, len(doc_ids), len(ranks), len(data))
    body = np.array(doc_ids, "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + control + data
    return head + struct.pack("<I", zlib.crc32(body)) + body


def read_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, sizes, ranks) of a shard; ValueError if it is damaged."""
    magic, version, docs, n, n_data = struct.unpack_from("<4sIQQQ", blob)
    (crc,) = struct.unpack_from("<I", blob, 32)
    if magic != MAGIC or version != 1 or zlib.crc32(memoryview(blob)[36:]) != crc:
        raise ValueError("not a shard, or a damaged one")
    at = 36 + 16 * docs
    ids, sizes = np.frombuffer(blob, "<i8", docs, 36), np.frombuffer(blob, "<u8", docs, 36 + 8 * docs)
    split = at + -(-n // 4)
    return ids, sizes.astype(np.int64), decode_values(blob[at:split], blob[split : split + n_data], n)


def tokenized(df: DataFrame, vocab: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", added: str = "text") -> DataFrame:
    """(doc_id, width, ids): the ids as little-endian numbers of `width` bytes, the end id last. added: see tokens.Encoder."""
    out = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab, "byte", added)
        kind = id_type(max(coder.size, end_id + 1))
        for b in slices(batches, BLOCK_BYTES):
            ids, ends = coder.encode_many(b.column(1))
            whole = np.insert(ids.astype(kind), ends, end_id)
            stops = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * kind.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(stops.astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])
            yield batch(out, [b.column(0), np.full(len(ends), kind.itemsize, dtype=np.int32), blobs])

    arrow_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, width int, ids binary")


def _flat(b: pa.RecordBatch) -> np.ndarray:
    """The ids of all rows of a batch of (width, ids)."""
    column = b.column(1)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(f"<u{b.column(0)[0].as_py()}")


def rank_table(ids: DataFrame) -> np.ndarray:
    """Ids by falling count over all documents (ties: the smaller id); as long as the vocabulary at most."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                found = np.bincount(_flat(b), minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
        at = np.flatnonzero(counts)
        yield batch(out, [at, counts[at]])

    rows = ids.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], dtype=np.uint32)


def write_files(ids: DataFrame, ranks: np.ndarray, path: str, partitions: int | None = None) -> None:
    """Write shards of (doc_id, width, ids) rows to path, in ascending doc_id order: (part, k) is their order."""
    spark = ids.sparkSession
    place = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, dtype=np.uint32)
    place[ranks] = np.arange(len(ranks), dtype=np.uint32)
    known = spark.sparkContext.broadcast(place)  # at most one number an id of the vocabulary
    out = pa.schema([*((c, pa.int64()) for c in ("part", "k", "first", "n_docs", "n_tokens")), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, first, docs, parts, tokens = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def shard() -> pa.RecordBatch:
            return batch(out, [[part], [k], [first], [len(docs)], [tokens], [write_shard(docs, [len(p) for p in parts], np.concatenate(parts))]])

        for b in slices(batches):
            ranked = known.value[_flat(b.select(["width", "ids"]))]
            stops = (np.cumsum(pc.binary_length(b.column(2)).to_numpy()) // b.column(1)[0].as_py()).tolist()
            for doc, start, stop in zip(values(b.column(0)), [0, *stops], stops, strict=False):
                docs.append(_NULL if doc is None else doc)
                parts.append(ranked[start:stop])
                tokens += stop - start
                if tokens >= SHARD_TOKENS:
                    yield shard()
                    k, first, docs, parts, tokens = k + 1, first + tokens, [], [], 0
        if docs:
            yield shard()

    order = ["doc_id", "tie", "ids"]
    tied = ids.select("doc_id", "width", "ids", F.xxhash64("ids").alias("tie"))
    dealt = tied.repartitionByRange(*([partitions] if partitions else []), "doc_id", "tie").sortWithinPartitions(*order).drop("tie")
    dealt.mapInArrow(run, _SHARDS).write.option("compression", "none").parquet(path)
    _write_ranks(spark, ranks, path)


def _write_ranks(spark, ranks: np.ndarray, path: str) -> None:
    """The ids by rank, in a folder of their own beside the shards, which readers of these leave out: at most an id a word of the vocabulary."""
    data = ranks.astype("<u4").tobytes()
    spark.createDataFrame([(1, len(ranks), zlib.crc32(data), bytearray(data))], _RANKS).coalesce(1).write.parquet(f"{path}/{_RANK_FOLDER}")


def read_ranks(spark, path: str) -> np.ndarray:
    """The ids by rank that write_files() stored; ValueError if they are damaged."""
    version, n, crc, data = spark.read.schema(_RANKS).parquet(f"{path}/{_RANK_FOLDER}").first()
    if version != 1 or len(data) != 4 * n or zlib.crc32(data) != crc:
        raise ValueError("not a rank table, or a damaged one")
    return np.frombuffer(bytes(data), "<u4")


def read_files(spark, path: str, ranks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; ranks: those that are stored there."""
    ranks = read_ranks(spark, path) if ranks is None else ranks
    stored = spark.read.schema(_SHARDS).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a number a write task
    starts, total = {}, 0
    for r in sorted(parts):
        starts[r.part] = total
        total += r.n
    known = spark.sparkContext.broadcast((ranks, starts))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank, before = known.value
        for b in slices(batches, rows=1):
            for part, first, blob in zip(*(values(b.column(c)) for c in (0, 2, 5)), strict=True):
                docs, sizes, coded = read_shard(blob)
                ids = by_rank[coded].astype("<u4")
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield batch(out, [[None if d == _NULL else d for d in docs.tolist()], before[part] + first + ends - sizes, sizes, crcs])

    arrow_batches(spark)
    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir):
    ids = saved(tokenized(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), added="ids"), "ids")
    ranks = rank_table(ids)
    path = new_path(spark, "token-shards")
    write_files(ids, ranks, path)
    dropped(ids)
    return read_files(spark, path)
