"""Retrieval scoring: spans found in ranked chunks, hit@k, recall@k, MRR, by query and aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import span_in_chunk


def first_ranks(found: DataFrame, by: list[str]) -> DataFrame:
    """(…, span_ix, first_rank) from matches (…, span_ix, rank): a span counts once, at its first rank."""
    return found.groupBy(*by, "span_ix").agg(F.min("rank").alias("first_rank"))


def span_matches(ranked: DataFrame, spans: DataFrame, by: list[str], k: int) -> DataFrame:
    """Matches of ranked chunks (by, rank, section, text) and spans (query_id, span_ix, section, quote)."""
    spans = spans.select("query_id", "span_ix", F.col("section").alias("want"), "quote")
    return ranked.where(F.col("rank") <= k).join(spans, "query_id").where(span_in_chunk(F.col("section"), F.col("text"), F.col("want"), F.col("quote"))).select(*by, "span_ix", "rank")


def query_scores(queries: DataFrame, matches: DataFrame, retrieved: DataFrame, by: list[str], k: int) -> DataFrame:
    """hit, recall, mrr, matched_ranks, n_expected, n_retrieved for each row of queries (by, n_expected).

    Queries without spans or results keep their row, with zeros.
    """
    firsts = first_ranks(matches, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched"), F.min("first_rank").alias("first"), F.array_sort(F.collect_list(F.struct("first_rank", "span_ix"))).alias("order")
    )
    n = retrieved.where(F.col("rank") <= k).groupBy(*by).agg(F.count(F.lit(1)).alias("n_retrieved"))
    joined = queries.join(firsts, by, "left").join(n, by, "left")
    ranks = F.coalesce(F.transform("order", lambda x: x["first_rank"]), F.array().cast("array<bigint>"))
    return joined.select(
        *by,
        (F.coalesce("matched", F.lit(0)) > 0).alias("hit"),
        F.round(F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("n_expected")), F.lit(0.0)), 4).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        ranks.alias("matched_ranks"),
        F.col("n_expected").cast("long").alias("n_expected"),
        F.coalesce("n_retrieved", F.lit(0)).cast("long").alias("n_retrieved"),
    )


def metrics() -> list:
    """Means over queries of hit, of the rounded recall and of the rounded mrr, rounded, and their count."""
    return [
        F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_at_k"),
        F.round(F.avg("recall"), 4).alias("recall_at_k"),
        F.round(F.avg("mrr"), 4).alias("mrr"),
        F.count(F.lit(1)).alias("n_queries"),
    ]


def report(scores: DataFrame, whole: str, part: str) -> DataFrame:
    """Metrics by `whole`, and by `whole` and `part`, in one pass; the overall rows have a null part."""
    return scores.groupingSets([[F.col(whole)], [F.col(whole), F.col(part)]], F.col(whole), F.col(part)).agg(*metrics())


def enriched(scores: DataFrame, queries: DataFrame, on: list[str]) -> DataFrame:
    """Scores with the question and rationale of their query, where there is one."""
    return scores.join(queries, on, "left")


def by_strategy(scores: DataFrame, strategies: list[str]) -> DataFrame:
    """A row a query with hit and mrr of each strategy."""
    return scores.groupBy("query_id").pivot("strategy", strategies).agg(F.max(F.col("hit").cast("int")).alias("hit"), F.max("mrr").alias("mrr"))
