"""Blocks of cosine products on executors: batches of vectors against a matrix of queries, or tiles of both sides.

Tiles: queries and chunks are dealt by hash into parts of bounded bytes, and each pair of a tile of queries and a part of
chunks is a group of its own: a grid, not a product of rows. A group hands on its k best rows a query.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMALS = 6
#: Bytes of query vectors of a tile, and of chunk vectors of a part.
TILE_BYTES, PART_BYTES = 16 << 20, 64 << 20
#: k up to which a task holds its best rows to its end; above, it hands on all rows.
LOCAL_K = 1000
#: Rows of chunks in one product, and scores of cosine_sums() at once.
ROWS, CELLS = 1024, 1 << 20


def unit_rows(vectors: list, size: int) -> np.ndarray:
    """Vectors as rows of length 1; null ones, those of another size, and zero ones as zero rows."""
    out = np.zeros((len(vectors), size))
    for n, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[n] = v if isinstance(v, np.ndarray) else [0.0 if x is None else x for x in v]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _matrix(vectors: pa.ListArray, size: int) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    if (lengths == size).all():
        out = pc.fill_null(vectors.flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
    return unit_rows(vectors.to_pylist(), size)


def query_rows(rows: pa.Table) -> list[tuple]:
    """(query_id, vector, scope) of a table with these columns; vectors as slices of one array, null elements as 0, null vectors as None."""
    vectors = rows["vector"].combine_chunks()
    flat = pc.fill_null(vectors.flatten(), 0.0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()).tolist()
    known = vectors.is_valid().to_pylist()
    cut = [flat[a:b] if ok else None for a, b, ok in zip([0, *ends], ends, known, strict=False)]
    return list(zip(rows["query_id"].to_pylist(), cut, rows["scope"].to_pylist() if "scope" in rows.column_names else [None] * len(cut), strict=True))


def vector_bytes(vector: str) -> Column:
    return F.coalesce(F.size(vector), F.lit(0)) * 8 + 64


def tiled(chunks: DataFrame, queries: DataFrame, k: int, schema: str, tile_bytes: int | None = None, part_bytes: int | None = None) -> DataFrame:
    """(query_id, scope, key, score) of the k best rows of each group of a tile of queries and a part of chunks.

    chunks: (scope, key, vector); queries: (query_id, vector[, scope]): with a scope they meet its chunks only. Vectors are arrays of doubles.
    """
    scoped = "scope" in queries.columns
    by = ["scope"] if scoped else []
    parts = lambda df, n, most: df.groupBy(*by).agg(F.greatest(F.ceil(F.sum(vector_bytes("vector")) / most), F.lit(1)).cast("int").alias(n))
    tiles, shares = parts(queries, "tiles", tile_bytes or TILE_BYTES), parts(chunks, "parts", part_bytes or PART_BYTES)
    if scoped:  # a row a scope that both sides have
        grid = tiles.join(shares, "scope")
        q, c = queries.join(grid, "scope"), chunks.join(grid, "scope")
    else:
        n, m = tiles.first()[0], shares.first()[0]
        q, c = (df.withColumns({"tiles": F.lit(n), "parts": F.lit(m)}) for df in (queries, chunks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.withColumn("tile", F.pmod(F.xxhash64("query_id"), "tiles").cast("int")).withColumn("part", every("parts")).drop("tiles", "parts")
    c = c.withColumn("part", F.pmod(F.xxhash64("scope", "key"), "parts").cast("int")).withColumn("tile", every("tiles")).drop("tiles", "parts")
    on = [*by, "tile", "part"]

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = best_cosines(iter(rows.select(["scope", "key", "vector"]).to_batches()), query_rows(asked), scoped, k) if asked.num_rows and rows.num_rows else iter(())
        ids = pa.schema([asked.schema.field("query_id"), rows.schema.field("scope"), rows.schema.field("key"), pa.field("score", pa.float64())])
        return pa.Table.from_batches([b.cast(ids) for b in found], schema=ids)

    return q.groupBy(*on).cogroup(c.groupBy(*on)).applyInArrow(run, schema)


def rounded(x: np.ndarray) -> np.ndarray:
    """At DECIMALS decimals, halves away from zero."""
    scale = 10.0**DECIMALS
    return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x) + 0.0


def _first(scores: np.ndarray, keys: list, k: int) -> list[int]:
    """The k best by score, then key, of one query's rows."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return sorted(at.tolist(), key=lambda n: (-scores[n], keys[n]))[:k]


def best_cosines(batches: Iterator[pa.RecordBatch], queries: list[tuple], scoped: bool, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, scope, key, score) of each query's k best rows (scope, key, vector) of a task, by scope.

    queries: (query_id, vector[, scope]); with scopes, a query meets the rows of its scope only. Sizes of
    vectors can differ among queries; each size is a matrix of its own.
    """
    groups: dict[tuple, list[tuple]] = defaultdict(list)  # by size, and scope if queries have one
    for q in queries:
        groups[0 if q[1] is None else len(q[1]), q[2] if scoped else None].append(q)
    matrices = {g: unit_rows([q[1] for q in qs], g[0]) for g, qs in groups.items()}
    held: dict[tuple, tuple[np.ndarray, list]] = {}  # by query and scope: best scores and their keys
    schema = None
    for whole in batches:
        for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
            scopes, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            places: dict[object, list[int]] = defaultdict(list)
            for n, scope in enumerate(scopes):
                places[scope].append(n)
            sizes = {g[0] for g in groups}
            rows = {size: _matrix(b.column(2), size) for size in sizes}
            out: list[tuple] = []
            for (size, wanted), qs in groups.items():
                for scope, at in places.items():
                    if scoped and scope != wanted or scope is None:
                        continue
                    scores = rounded(rows[size][at] @ matrices[size, wanted].T)
                    names = [keys[n] for n in at]
                    for column, (qid, *_) in enumerate(qs):
                        mine = scores[:, column]
                        if k > LOCAL_K:
                            out += zip([qid] * len(at), [scope] * len(at), names, mine.tolist(), strict=True)
                            continue
                        before = held.get((column, size, wanted, scope))
                        if before is not None and len(before[0]) == k:
                            better = np.flatnonzero(mine >= before[0][-1])
                            if not len(better):
                                continue
                        else:
                            better = np.arange(len(at))
                        both = mine[better] if before is None else np.concatenate([before[0], mine[better]])
                        both_names = ([] if before is None else before[1]) + [names[n] for n in better.tolist()]
                        best = _first(both, both_names, k)
                        held[column, size, wanted, scope] = both[best], [both_names[n] for n in best]
            if out:
                yield _rows(out, b.schema)
            schema = b.schema
    out = [(groups[size, wanted][column][0], scope, key, score) for (column, size, wanted, scope), (scores, names) in held.items() for key, score in zip(names, scores.tolist(), strict=True)]
    for at in range(0, len(out), 8192):
        yield _rows(out[at : at + 8192], schema)


def cosine_sums(batches: Iterator[pa.RecordBatch], queries: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(query_id, n, total, best) over a task's rows (scope, key, vector): how many, the sum of rounded scores in units of the last
    decimal (whole numbers, so their order doesn't matter), and the greatest score of a row whose key isn't the query's id (or null)."""
    groups: dict[int, list] = defaultdict(list)  # by size
    for q in queries:
        groups[0 if q[1] is None else len(q[1])].append(q)
    matrices = {size: unit_rows([q[1] for q in qs], size) for size, qs in groups.items()}
    places = {size: {q[0]: n for n, q in enumerate(qs)} for size, qs in groups.items()}
    totals = {size: np.zeros(len(qs), dtype=np.int64) for size, qs in groups.items()}
    bests = {size: np.full(len(qs), -np.inf) for size, qs in groups.items()}
    seen, step = 0, max(1, min(ROWS, CELLS // max(map(len, groups.values()), default=1)))
    for whole in batches:
        for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
            keys = b.column(1).to_pylist()
            seen += len(keys)
            for size, matrix in matrices.items():
                scores = rounded(_matrix(b.column(2), size) @ matrix.T)
                totals[size] += np.rint(scores * 10.0**DECIMALS).astype(np.int64).sum(axis=0)
                for row, key in enumerate(keys):
                    if (own := places[size].get(key)) is not None:
                        scores[row, own] = -np.inf
                np.maximum(bests[size], scores.max(axis=0), out=bests[size])
    for size, qs in groups.items():
        if seen:
            best = pa.array(bests[size], mask=np.isneginf(bests[size]))
            yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in qs]), pa.array(np.full(len(qs), seen)), pa.array(totals[size]), best], names=["query_id", "n", "total", "best"])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    ids, scopes, keys, scores = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scopes, type=schema.field(0).type), pa.array(keys, type=schema.field(1).type), pa.array(scores, type=pa.float64())], names=["query_id", "scope", "key", "score"])
