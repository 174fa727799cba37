"""A stored BM25 index: postings written once, in document blocks with their maxima, and top-k search that skips blocks.

The chunks of a scope (the corpus that statistics are over) are dealt into blocks of about BLOCK_CHUNKS by a hash of their key. A
row of the postings table is (bucket, scope, term, block): the block's chunks that have the term, the greatest term
frequency and the least length among them. So no row grows with the corpus, however common a term is, and texts are read once, when
the index is built: statistics come from the postings (the empty term stands for all chunks of a block).

A block's bound for a query is the sum over terms of what its maxima could give. The FIRST blocks by bound are scored; the k-th
score among them is a floor; blocks whose bound is below it can't hold one of the k best, and only the others are scored.
Bounds are kept clear of rounding by SLACK. Results are those of scoring everything. Where the queries' words could meet FEW_POSTINGS
postings at most (words of queries times chunks), bounds cost more than they save, and all blocks are scored in one pass.

Layout: terms go to buckets (folders), so that a query's terms name the folders to read; within a file rows are sorted by scope
and term. All steps are joins and grouped sums of DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Scores are compared at this many decimals, so that the order of float sums doesn't decide ties.
DECIMALS = 6
SLACK = 3e-6
#: Rows that a side may have to be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: Chunks of a block on average, chunks of a scope for each bucket of terms, and blocks that are scored for the floor.
BLOCK_CHUNKS, BUCKET_CHUNKS, FIRST = 64, 4_000_000, 2
#: Postings that are scored without asking bounds first; results don't depend on it.
FEW_POSTINGS = 200_000_000
_ALL = ""  # the term that all chunks have


@dataclass(frozen=True)
class Bm25Index:
    chunks: DataFrame  # scope, key, other columns
    blocks: DataFrame  # bucket, scope, term, block, n, dls, max_tf, min_dl, postings
    terms: DataFrame  # bucket, scope, term, df, idf, avgdl
    stats: DataFrame  # scope, n, avgdl, mean (of its terms' raw idf)
    scopes: int  # how many there are
    largest: int  # chunks of the largest scope
    total: int  # chunks of all scopes
    path: str

    @property
    def postings(self) -> DataFrame:
        """scope, key, term, tf"""
        return self.blocks.where(F.col("term") != _ALL).select("scope", "term", F.inline("postings")).select("scope", "key", "term", "tf")

    @property
    def lengths(self) -> DataFrame:
        """scope, key, dl of all chunks"""
        return self.blocks.where(F.col("term") == _ALL).select("scope", F.inline("postings")).select("scope", "key", "dl")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has few rows at most, as bounded by the caller; else df, which joins then shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def postings_of(chunks: DataFrame, scopes: int, counts: DataFrame, buckets: int) -> DataFrame:
    """The rows of the postings table. Texts are read once and shuffled once, by block: a block's words are counted, and its postings gathered, where it lies."""
    placed = chunks.join(small(counts.select("scope", F.ceil(F.col("n") / BLOCK_CHUNKS).alias("n_blocks")), scopes), "scope")
    dealt = placed.select("scope", "key", F.pmod(F.xxhash64("key"), "n_blocks").alias("block"), "text").repartition("scope", "block")
    rows = dealt.select("scope", "key", "block", tokens("text").alias("words"))
    every = rows.select("scope", "key", "block", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit(_ALL)), "words")).alias("term"))
    n = F.count(F.lit(1)).cast("int")
    each = every.groupBy("scope", "key", "block", "dl", "term").agg(F.when(F.col("term") == _ALL, F.lit(0)).otherwise(n).alias("tf"))
    gathered = F.sort_array(F.collect_list(F.struct("key", "tf", "dl")))
    grouped = each.groupBy("scope", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dl").cast("long")).alias("dls"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), gathered.alias("postings"))
    cut = grouped.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "*").select("bucket", "scope", "term", "block", "n", "dls", "max_tf", "min_dl", "postings")
    return (cut.hint("rebalance", "bucket") if buckets > 1 else cut).sortWithinPartitions("bucket", "scope", "term", "block")


def build(chunks: DataFrame, path: str, scope: str = "scope", key: str = "key", text: str = "text", epsilon: float = EPSILON) -> Bm25Index:
    """Write the index of chunks to path. A term in over half of a scope's chunks gets epsilon times the mean idf of its terms."""
    named = chunks.select(F.col(scope).alias("scope"), F.col(key).alias("key"), F.col(text).alias("text")).where("scope IS NOT NULL AND key IS NOT NULL")
    counts = storage.stored(named.groupBy("scope").agg(F.count(F.lit(1)).alias("n")), f"{path}/counts")  # reads no text
    total, scopes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = storage.stored(postings_of(named, scopes, counts, -(-total // BUCKET_CHUNKS) or 1), f"{path}/postings", "bucket")
    df = blocks.where(F.col("term") != _ALL).groupBy("bucket", "scope", "term").agg(F.sum("n").alias("df"))
    df = storage.stored(df, f"{path}/terms")
    stats = blocks.where(F.col("term") == _ALL).groupBy("scope").agg(F.sum("n").alias("n"), (F.sum("dls") / F.sum("n")).alias("avgdl"))
    rare = df.join(small(counts, scopes), "scope").groupBy("scope").agg(F.avg(_raw_idf()).alias("mean"))
    storage.stored(stats.join(small(rare, scopes), "scope", "left").withColumn("epsilon", F.lit(float(epsilon))), f"{path}/stats")
    return opened(chunks, path, scope, key)


def _raw_idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def opened(chunks: DataFrame, path: str, scope: str = "scope", key: str = "key") -> Bm25Index:
    """The index that build() wrote to path; chunks are asked for conditions on results only."""
    spark: SparkSession = chunks.sparkSession
    s, k = (chunks.schema[c].dataType.simpleString() for c in (scope, key))
    blocks = spark.read.schema(f"bucket int, scope {s}, term string, block long, n long, dls long, max_tf int, min_dl int, postings array<struct<key: {k}, tf: int, dl: int>>").parquet(f"{path}/postings")
    df = spark.read.schema(f"bucket int, scope {s}, term string, df long").parquet(f"{path}/terms")
    stats = spark.read.schema(f"scope {s}, n long, avgdl double, mean double, epsilon double").parquet(f"{path}/stats")
    largest, total, scopes = stats.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    idf = F.when(_raw_idf() < 0, F.col("epsilon") * F.col("mean")).otherwise(_raw_idf())
    terms = df.join(small(stats, scopes), "scope").select("bucket", "scope", "term", "df", idf.alias("idf"), "avgdl")
    return Bm25Index(chunks.withColumnsRenamed({scope: "scope", key: "key"}), blocks, terms, stats.drop("epsilon"), scopes, largest, total, path)


def query_terms(queries: DataFrame, query_id: str = "query_id", question: str = "question") -> DataFrame:
    """(query_id, term, qtf), and scope if queries have one; repeated words count repeatedly."""
    scope = [c for c in ("scope",) if c in queries.columns]
    exploded = queries.select(F.col(query_id).alias("query_id"), *scope, F.explode(tokens(question)).alias("term"))
    return exploded.groupBy("query_id", *scope, "term").agg(F.count(F.lit(1)).alias("qtf"))


def _part(tf: str, dl: str, k1: float, b: float) -> Column:
    """What a term gives a chunk, but for its weight; it grows with tf and falls with dl."""
    return F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.col("avgdl")))


class Search:
    """The queries' terms with their weights, and scores of all blocks or of some."""

    def __init__(self, index: Bm25Index, queries: DataFrame, k1: float = K1, b: float = B) -> None:
        q = query_terms(queries)
        on = ["scope", "term"] if "scope" in q.columns else ["term"]
        n = q.limit(BROADCAST_ROWS + 1).count()
        self.index, self.k1, self.b = index, k1, b
        self.most = n if "scope" in q.columns else n * max(index.scopes, 1)
        self.few = n <= BROADCAST_ROWS and n * index.total <= FEW_POSTINGS
        found = index.terms.join(small(q, n), on)
        self.wanted = found.select("query_id", "bucket", "scope", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl")

    def bounds(self) -> DataFrame:
        """(query_id, scope, block, bound): no chunk of the block scores more."""
        summary = self.index.blocks.select("bucket", "scope", "term", "block", "max_tf", "min_dl")
        met = summary.join(small(self.wanted, self.most), ["bucket", "scope", "term"])
        return met.groupBy("query_id", "scope", "block").agg(F.sum(F.greatest("weight", F.lit(0.0)) * _part("max_tf", "min_dl", self.k1, self.b)).alias("bound"))

    def scores(self, chosen: DataFrame | None = None) -> DataFrame:
        """(query_id, scope, key, score) of all chunks with a term of the query, or of those in the chosen blocks (query_id, scope, block)."""
        rows = self.index.blocks.select("bucket", "scope", "term", "block", "postings")
        if chosen is None:
            met = rows.join(small(self.wanted, self.most), ["bucket", "scope", "term"])
        else:
            met = rows.join(small(self.wanted, self.most), ["bucket", "scope", "term"]).join(chosen, ["query_id", "scope", "block"], "left_semi")
        hits = met.select("query_id", "scope", "weight", "avgdl", F.inline("postings"))
        return hits.groupBy("query_id", "scope", "key").agg(F.round(F.sum(F.col("weight") * _part("tf", "dl", self.k1, self.b)), DECIMALS).alias("score"))

    def every(self, where: Column | None = None) -> DataFrame:
        """All positive scores of chunks for which the condition on columns of chunks holds."""
        return self._allowed(self.scores(), where)

    def _allowed(self, scored: DataFrame, where: Column | None) -> DataFrame:
        positive = scored.where("score > 0")
        return positive if where is None else positive.join(self.index.chunks.where(where).select("scope", "key"), ["scope", "key"], "left_semi")

    def best(self, k: int, where: Column | None = None) -> DataFrame:
        """Positive scores that include each query's and scope's k best; blocks that can't hold one of them are skipped."""
        if self.index.largest <= FIRST * BLOCK_CHUNKS:  # a scope's blocks are all among the first
            return self.every(where)
        bounds = self.bounds().where("bound > 0")
        order = Window.partitionBy("query_id", "scope").orderBy(F.desc("bound"), "block")
        first = bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST).select("query_id", "scope", "block")
        by_score = Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "key")
        floor = self._allowed(self.scores(first), where).withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k).select("query_id", "scope", F.col("score").alias("floor"))
        left = bounds.join(floor, ["query_id", "scope"], "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK)
        return self._allowed(self.scores(left.select("query_id", "scope", "block")), where)
