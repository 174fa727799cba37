"""Resumable extraction: a file stream of documents, asked in micro-batches, each saved before the next.

A run is a stream with a checkpoint that ends when all files that are there have been asked (availableNow). A stopped run's
checkpoint is used by the next start, which goes on with the first batch that wasn't committed; of that batch, documents with a
saved answer aren't asked again. A finished run is marked, and the next start is a new one: it asks the documents that have no
answer yet, among them those whose call failed. A batch's answers are written apart before they are saved, so a start that
finds them asks none of that batch. Answers of a batch that was stopped amid its calls are lost, so `batch` bounds
what may be asked twice; at 1 it is nothing but the call that was under way.

A limit of calls a second holds for all tasks together: a batch is dealt to `lanes` tasks, and each waits lanes / rate seconds
between its calls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.operators import extraction
from rankloom.sources import readers, sinks


@dataclass
class Progress:
    """Documents that were asked and those whose call failed, in this start."""

    asked: int = 0
    failed: int = 0


@dataclass(frozen=True)
class Limits:
    """batch: files of a micro-batch; lanes: tasks that call at a time; rate: calls a second over all tasks, None for no limit."""

    batch: int = 16
    lanes: int = 4
    rate: float | None = None

    @property
    def pause_s(self) -> float:
        return self.lanes / self.rate if self.rate else 0.0


def attempt_of(spark: SparkSession, out: str, model: str) -> str:
    """The folder of the run that is under way, or of a new one."""
    n = 0
    while storage.exists(spark, f"{(at := _attempt(out, model, n))}/finished"):
        n += 1
    return at


def _attempt(out: str, model: str, n: int) -> str:
    return f"{out.rstrip('/')}-progress/{sinks.folder_name(model)}/{n:06d}"


def extract_all(spark: SparkSession, root: str, spec: DataFrame, chat: extraction.Chat, model: str, out: str, docs: list[str] | None = None, limits: Limits = Limits(), **options) -> Progress:
    """Ask about all documents <root>/<doc_id>/source.md (or of those in docs) that have no answer at out, and save runs there.

    KeyError if a document that is to be asked has no field specification; nothing has been asked for its batch then.
    """
    progress, at = Progress(), attempt_of(spark, out, model)

    def ask(batch: DataFrame, n: int) -> None:
        path = f"{at}/answers/{n}"
        fresh = not storage.exists(spark, f"{path}/_SUCCESS")
        if fresh:
            wanted = batch if docs is None else batch.where(F.col("doc_id").isin(*docs))
            left = extraction.pending(wanted, sinks.load_runs(spark, out), model)
            extraction.extract(left.repartition(limits.lanes), spec, chat, model, pause_s=limits.pause_s, **options).write.mode("overwrite").parquet(path)
        answers = spark.read.schema(extraction.ANSWERS).parquet(path)  # kept apart from `out`, which they are saved to now
        sinks.save_runs(extraction.to_runs(answers, spec), out)
        if fresh:
            counts = answers.agg(F.count(F.lit(1)).alias("asked"), F.count("error").alias("failed")).first()
            progress.asked += counts.asked
            progress.failed += counts.failed

    stream = readers.document_stream(spark, root, limits.batch)
    query = stream.writeStream.foreachBatch(ask).trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint").start()
    query.awaitTermination()
    storage.delete(spark, f"{at}/answers")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{at}/finished")
    return progress
