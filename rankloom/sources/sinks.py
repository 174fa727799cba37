"""Sinks: reports as JSON or Parquet, runs merged by partition, appended caches, baselines, console tables."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import storage


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def retrieval_report(overall: DataFrame, per_doc: DataFrame, per_query: DataFrame) -> DataFrame:
    """One nested row a strategy: metrics, metrics by document, scores by query."""
    metrics = F.struct("hit_at_k", "recall_at_k", "mrr", "n_queries")
    docs = per_doc.groupBy("strategy").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", metrics.alias("m"))))).alias("per_doc"))
    fields = [c for c in per_query.columns if c != "strategy"]
    queries = per_query.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("query_id", *[c for c in fields if c != "query_id"]))).alias("per_query"))
    return overall.select(F.col("strategy").alias("name"), metrics.alias("metrics"), "strategy").join(docs, "strategy", "left").join(queries, "strategy", "left").drop("strategy")


def save_runs(rows: DataFrame, path: str) -> None:
    """Write long run rows; only the (model, doc_id) partitions that rows has are replaced."""
    named = rows.withColumn("field", F.coalesce("field", F.lit(""))) if "error" in rows.columns else rows
    named.withColumn("value", F.to_json("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "doc_id").parquet(path)


#: Columns of saved runs; value is JSON text in files.
RUN_COLUMNS = "created_at timestamp, field string, value string, error string, error_type string, model string, doc_id string"


def load_runs(spark, path: str) -> DataFrame:
    """Long run rows that save_runs() has written; none if there are no files yet."""
    rows = spark.read.schema(RUN_COLUMNS).parquet(path) if storage.exists(spark, path) else spark.createDataFrame([], RUN_COLUMNS)
    return rows.withColumn("field", F.nullif("field", F.lit(""))).withColumn("value", F.try_parse_json("value")).withColumns({c: F.col(c).cast("string") for c in ("model", "doc_id")})


def folder_name(name: str) -> str:
    """A folder's name that no two names share."""
    return f"{re.sub('[^A-Za-z0-9.]+', '-', name)}-{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def append_cache(new: DataFrame, path: str) -> None:
    """Append vectors of texts that the cache missed, as lines {"model", "h", "v"}, which readers.embedding_cache() reads back."""
    new.where("v IS NOT NULL").select("model", "h", "v").write.mode("append").json(path)


def save_baseline(current: DataFrame, stale: DataFrame, path: str) -> bool:
    """Write a new baseline if the old one lacks a model; whether it did. One JSON object by model, which readers.baseline() reads back.

    A baseline is a row a model, so it is collected before the file that `current` may depend on is replaced.
    """
    if stale.limit(1).count() == 0:
        return False
    metrics = ("precision", "recall", "f1", "n_documents")
    whole = {r.model: {m: r[m] for m in metrics} for r in current.select("model", *metrics).orderBy("model").collect()}
    spark = current.sparkSession
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return True


def table_text(df: DataFrame, rows: int = 100) -> str:
    """A small report as a fixed-width table."""
    found = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(rows).collect()]
    widths = [max(len(c), *(len(r[i]) for r in found)) if found else len(c) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, found)])
