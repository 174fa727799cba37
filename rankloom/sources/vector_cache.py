"""A table of embedding vectors by model and text hash, which texts are joined with where it lies.

Files are in folders by model, and within a model bucketed by hash: a join or a grouping on the hash shuffles the texts'
hashes to the table's buckets, and the table itself isn't shuffled. Models never mix, as each has a folder of its own. New vectors
are appended (a failed job leaves nothing behind); of several for a text the last appended holds; compact() rewrites a model's
folder with one row a text, in one file a bucket.

Defined cases: a null vector or hash isn't stored; a path without a table is an empty one; a model's name can hold any characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.functions.text import text_hash
from rankloom.sources.sinks import folder_name

BUCKETS = 64


class VectorCache:
    """buckets is part of a table's folder, so that it is always read as it was written; raise it for large tables."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, f"{path.rstrip('/')}/by-hash-{buckets}", buckets

    def folder(self, model: str) -> str:
        """A model's folder: its name as far as a path can hold it, and a digest that tells alike ones apart."""
        return f"{self.path}/{folder_name(model)}"

    @contextmanager
    def _named(self, path: str) -> Iterator[str]:
        """A name in the session's catalog for the files at path, as only a table in a catalog can be read and written by buckets."""
        name, at = f"rankloom_vectors_{uuid.uuid4().hex}", path.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} (h STRING, v ARRAY<DOUBLE>, at TIMESTAMP) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # an external table: the files stay

    def rows(self, model: str) -> DataFrame:
        """(model, h, v) of a model, one row a text; grouped by bucket, without a shuffle."""
        with self._named(self.folder(model)) as name:
            mine = self.spark.table(name)  # resolved: it keeps the buckets and the files, also without the name
        return mine.groupBy("h").agg(F.max_by("v", "at").alias("v")).select(F.lit(model).alias("model"), "h", "v")

    def append(self, new: DataFrame, model: str) -> None:
        """Store the model's rows of new (model, h, v)."""
        good = new.where((F.col("model") == model) & F.col("h").isNotNull() & F.col("v").isNotNull())
        self._write(good.select("h", F.col("v").cast("array<double>").alias("v")), self.folder(model))

    def _write(self, rows: DataFrame, path: str) -> None:
        with self._named(path) as name:
            rows.withColumn("at", F.current_timestamp()).repartition(self.buckets, "h").write.insertInto(name)

    def misses(self, texts: DataFrame, model: str, text: str = "text") -> DataFrame:
        """(h, text) of distinct texts that the model has no vector of."""
        asked = texts.select(text_hash(text).alias("h"), F.col(text).alias("text")).where("text IS NOT NULL").dropDuplicates(["h"])
        return asked.join(self.rows(model).select("h"), "h", "left_anti")

    def with_vectors(self, texts: DataFrame, model: str, text: str = "text") -> DataFrame:
        """texts with their vector v; those without one are left out. Columns of texts stay as they are, but for one named v."""
        held = self.rows(model).select(F.col("h").alias("__hash"), "v")
        return texts.drop("v").withColumn("__hash", text_hash(text)).join(held, "__hash").drop("__hash")

    def compact(self, model: str) -> None:
        """Rewrite a model's folder with the rows that hold; readers that began before may have to begin again."""
        folder = self.folder(model)
        if storage.exists(self.spark, folder):
            fresh = f"{folder}-compacting-{uuid.uuid4().hex}"
            self._write(self.rows(model).select("h", "v"), fresh)
            storage.move(self.spark, fresh, folder)
