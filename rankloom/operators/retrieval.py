"""Ranking of chunks for queries: BM25, dense cosine, and reciprocal-rank fusion, for all queries at once.

A chunks table has a scope column (the corpus that statistics are over), a key (a total order within
it, which resolves ties) and text. `where` conditions hold for results only, never for statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.operators import postings, scan, vectors
from rankloom.operators.arrow import arrow_bytes
from rankloom.operators.postings import B, DECIMALS, EPSILON, K1, Bm25Index

K, RRF_K, DEPTH = 5, 60, 4
STRATEGIES = ("bm25", "dense", "hybrid")
#: Bytes of query vectors that may go to each task; beyond it they meet chunks in tiles.
QUERY_BYTES = 64 << 20


def bm25_index(chunks: DataFrame, scope: str = "scope", key: str = "key", text: str = "text", epsilon: float = EPSILON, path: str | None = None) -> Bm25Index:
    """The Okapi index of chunks, written to path (or to the shared folder); see postings.py. postings.opened() reads one that is there."""
    return postings.build(chunks, path or storage.fresh_path(chunks.sparkSession, "bm25"), scope, key, text, epsilon)


def bm25_scores(index: Bm25Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, scope, key, score) of all chunks that have a term; queries with a scope column are scored in that scope only."""
    return postings.Search(index, queries, k1, b).scores()


def in_section(part: str, section: str = "section") -> Column:
    """A `where` condition: the section's path holds `part`, in any case of letters."""
    return F.contains(F.lower(section), F.lit(part.lower()))


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id", "scope")) -> DataFrame:
    """The k best rows of each query (and scope) with their rank; ties by key."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def search_bm25(index: Bm25Index | scan.Corpus, queries: DataFrame, k: int = K, where: Column | None = None) -> DataFrame:
    """(query_id, scope, key, score, rank): positive scores only; `where` on chunk columns after scoring.

    Of a stored index blocks that can't matter are skipped; a counted corpus is scored where its texts lie, see scan.py.
    """
    if isinstance(index, scan.Corpus):
        return top(scan.best(index, queries, k, where), k)
    asked = postings.Search(index, queries)
    return top(asked.every(where) if asked.few else asked.best(k, where), k)


def search_dense(chunks: DataFrame, queries: DataFrame, k: int = K, where: Column | None = None) -> DataFrame:
    """Exact cosine ranking of chunks (scope, key, vector) for queries (query_id, vector[, scope]); nothing is dropped.

    Up to QUERY_BYTES of queries go to each task as one matrix of unit rows, which is multiplied with batches of chunks where
    these lie; a task keeps its k best a query, so that only these are shuffled. More queries meet chunks in tiles: see
    vectors.tiled(). A null vector, or one whose length differs from a query's, counts as a zero vector.
    """
    kept = chunks if where is None else chunks.where(where)
    scoped = "scope" in queries.columns
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *(["scope"] if scoped else []))
    rows = kept.select("scope", "key", F.col("vector").cast("array<double>").alias("vector"))
    kinds = {"query_id": queries.schema["query_id"].dataType, "scope": kept.schema["scope"].dataType, "key": kept.schema["key"].dataType}
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", score double"
    if (asked.agg(F.sum(vectors.vector_bytes("vector"))).first()[0] or 0) > QUERY_BYTES:
        return top(vectors.tiled(rows.where("scope IS NOT NULL"), asked, k, schema), k)
    shared = kept.sparkSession.sparkContext.broadcast(vectors.query_rows(asked.toArrow()))  # QUERY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return vectors.best_cosines(batches, shared.value, scoped, k)

    return top(rows.mapInArrow(run, schema), k)


def cosine_summary(chunks: DataFrame, queries: DataFrame, k_all: int = 1 << 30) -> DataFrame:
    """(query_id, n, mean, best) of the cosines of each query (query_id, vector) with all chunks (scope, key, vector); best leaves out
    the chunk whose key is the query's id. A task hands on a row a query, never a row a pair; beyond QUERY_BYTES of queries pairs meet in tiles."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    if (asked.agg(F.sum(vectors.vector_bytes("vector"))).first()[0] or 0) > QUERY_BYTES:
        found = search_dense(chunks, queries, k_all)
        best = F.max(F.when(F.col("key") != F.col("query_id"), F.col("score")))
        return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), best.alias("best"))
    rows = chunks.where("scope IS NOT NULL").select("scope", "key", F.col("vector").cast("array<double>").alias("vector"))
    shared = chunks.sparkSession.sparkContext.broadcast(vectors.query_rows(asked.toArrow()))  # QUERY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return vectors.cosine_sums(batches, shared.value)

    arrow_bytes(chunks.sparkSession)
    parts = rows.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, n long, total long, best double")
    mean = F.sum("total") / (F.sum("n") * F.lit(10.0**vectors.DECIMALS))
    return parts.groupBy("query_id").agg(F.sum("n").alias("n"), mean.alias("mean"), F.max("best").alias("best"))


def fuse(first: DataFrame, second: DataFrame, k: int = K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (query_id, scope, key, rank); ties by first rank, then second."""
    a = first.select("query_id", "scope", "key", F.col("rank").alias("r1"), F.lit(None).cast("long").alias("r2"))
    b = second.select("query_id", "scope", "key", F.lit(None).cast("long").alias("r1"), F.col("rank").alias("r2"))
    both = a.unionByName(b).groupBy("query_id", "scope", "key").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    term = lambda r: F.coalesce(F.lit(1.0) / (rrf_k + F.col(r)), F.lit(0.0))
    scored = both.withColumn("score", F.round(term("r1") + term("r2"), 9))
    order = Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), "key")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "scope", "key", "score", "rank", "r1", "r2")


def search(strategy: str, index: Bm25Index | scan.Corpus, chunks: DataFrame | None, queries: DataFrame, k: int = K, where: Column | None = None) -> DataFrame:
    """Dispatch. chunks: with vectors, or None without an embedder - then dense is empty and hybrid keeps BM25's order."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    depth = k if strategy != "hybrid" else DEPTH * k
    words = queries.drop("vector")
    lexical = search_bm25(index, words, depth, where) if strategy != "dense" else None
    if strategy == "bm25":
        return lexical
    if chunks is None:
        dense = search_bm25(index, words, 1).where("false")
    else:
        asked = queries.select("query_id", "vector", *[c for c in ("scope",) if c in queries.columns])
        dense = search_dense(chunks, asked, depth, where)
    if strategy == "dense":
        return dense
    return fuse(lexical, dense, k).select("query_id", "scope", "key", "score", "rank")


def cache_misses(chunks: DataFrame, cache: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """(h, text) of distinct texts without a cached vector; cache: (model, h, v)."""
    from rankloom.functions.text import text_hash

    known = cache if model is None else cache.where(F.col("model") == model)
    return chunks.select(text_hash(text).alias("h"), F.col(text).alias("text")).dropDuplicates(["h"]).join(known.select("h"), "h", "left_anti")
