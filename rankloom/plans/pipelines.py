"""End-to-end plans: the retrieval evaluation and the extraction evaluation, set-oriented."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import band, parsed_json
from rankloom.operators import chunking, evaluation, extraction, file_rules, retrieval, scoring, validation
from rankloom.sources import readers


def retrieval_scores(chunks: DataFrame, queries: DataFrame, k: int = retrieval.K, strategies: Sequence[str] = retrieval.STRATEGIES, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """Scores by strategy and query. chunks: (chunk_id, doc_id, chunk_ix, section, text); queries: (doc_id, query_id, question, expected_spans).

    Each document is a corpus of its own; the index is one plan for all strategies and documents.
    vectors: (chunk_id, vector), query_vectors: (query_id, vector); without them dense finds nothing.
    """
    corpus = chunks.select(F.col("doc_id").alias("scope"), F.col("chunk_ix").alias("key"), "chunk_id", "section", "text")
    index = retrieval.bm25_index(corpus)
    asked = queries.select("query_id", F.col("doc_id").alias("scope"), "question")
    placed = None
    if vectors is not None and query_vectors is not None:
        placed = corpus.join(vectors, "chunk_id").select("scope", "key", "section", "vector")
        asked = asked.join(query_vectors, "query_id", "left")
    ranked = None
    for s in strategies:
        found = retrieval.search(s, index, placed, asked, k).select(F.lit(s).alias("strategy"), "query_id", "scope", "key", "rank")
        ranked = found if ranked is None else ranked.unionByName(found)
    ranked = ranked.join(corpus.select("scope", "key", "section", "text"), ["scope", "key"])
    by = ["strategy", "query_id"]
    matches = evaluation.span_matches(ranked, readers.spans(queries), by, k)
    every = queries.select(F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"), "query_id", F.size("expected_spans").alias("n_expected"))
    scores = evaluation.query_scores(every, matches, ranked, by, k)
    return scores.join(queries.select("query_id", "doc_id", "question"), "query_id")


def run_retrieval_eval(spark: SparkSession, root: str, docs: Sequence[str] | None = None, k: int = retrieval.K, strategies: Sequence[str] = retrieval.STRATEGIES, **vectors) -> tuple[DataFrame, DataFrame]:
    """(scores by query, report by strategy and document) of a folder of golden documents."""
    names = readers.listed(spark, root, ("source.md", "retrieval.json"))
    names = names if docs is None else names.where(F.col("doc_id").isin(*docs))
    texts = readers.documents(spark, root).join(names, "doc_id", "left_semi")
    queries = readers.golden_queries(spark, root).join(names, "doc_id", "left_semi")
    scores = retrieval_scores(chunking.chunks(texts), queries, k, strategies, **vectors)
    return scores, evaluation.report(scores, "strategy", "doc_id")


def run_eval(spec: DataFrame, gold: DataFrame, runs: DataFrame, judged: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(field scores, document scores, model scores). judged: (model, doc_id, field, correct) verdicts on free text."""
    unknown = [r.doc_id for r in scoring.unknown_documents(spec, runs).limit(10).collect()]
    if unknown:
        raise KeyError(f"documents without a field specification: {unknown}")
    missing = [r.doc_id for r in runs.select("doc_id").distinct().join(gold.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("doc_id").limit(10).collect()]
    if missing:
        raise FileNotFoundError(f"documents without golden data: {missing}")
    fields = scoring.score_fields(scoring.field_pairs(spec, gold, runs.where("field IS NOT NULL").select("model", "doc_id", "field", "value").unionByName(_failed(runs))))
    if judged is not None:
        verdict = judged.select("model", "doc_id", "field", F.col("correct").alias("verdict"))
        fields = fields.join(verdict, ["model", "doc_id", "field"], "left").withColumn("score", F.when(F.col("verdict").isNotNull(), scoring.scalar_scores(F.col("verdict"))).otherwise(F.col("score"))).drop("verdict")
    flat = fields.select("model", "doc_id", "field", "field_ix", "category", "score.*")
    docs = scoring.document_scores(flat)
    return flat, docs, scoring.model_scores(docs)


def golden_checks(spark: SparkSession, root: str, spec_path: str, documents: int | None = None) -> DataFrame:
    """Constraint rows of the golden documents below root, of their queries, and of the specification as a set."""
    names = readers.documents(spark, root).select("doc_id")
    records = readers.golden_texts(spark, root).select("doc_id", parsed_json("text").alias("golden"))
    queries = readers.golden_queries(spark, root)
    asked = queries.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "question", "expected_spans")).alias("queries"))
    whole = names.unionByName(records.select("doc_id")).unionByName(asked.select("doc_id")).distinct()
    rows = whole.join(readers.documents(spark, root), "doc_id", "left").join(records, "doc_id", "left").join(asked, "doc_id", "left")
    rules = validation.golden_rules(list(validation.REQUIRED), list(validation.LISTS))
    spec = readers.whole_texts(spark, spec_path)
    return (
        validation.constraints(rows, F.col("doc_id"), rules)
        .unionByName(validation.constraints(queries, F.col("query_id"), validation.query_rules()))
        .unionByName(file_rules.specification_rules(spec, whole, documents))
    )


def failed_models(models: DataFrame, names: Sequence[str]) -> DataFrame:
    """Model scores with a row of zeros for each named model that has none, since its run is missing or unreadable."""
    wanted = models.sparkSession.createDataFrame([(n,) for n in names], "model string")
    zeros = wanted.join(models.select("model"), "model", "left_anti").select("model", *[F.lit(0.0).alias(c) for c in ("precision", "recall", "f1")], F.lit(0).cast("long").alias("n_documents"))
    return models.unionByName(zeros)


def run_judged_eval(spec: DataFrame, gold: DataFrame, runs: DataFrame, ask: extraction.Chat, system: str, retry: extraction.Retry = extraction.Retry()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """run_eval() with a judge's verdicts on free text that neither null decides."""
    pairs = scoring.needs_judge(scoring.field_pairs(spec, gold, runs.where("field IS NOT NULL").select("model", "doc_id", "field", "value")))
    asked = pairs.select(F.to_json(F.struct("model", "doc_id", "field")).alias("id"), "field", F.col("gold.s").alias("gold"), F.col("predicted.s").alias("predicted"))
    verdicts = extraction.judge(asked, ask, system, retry).withColumn("k", F.from_json("id", "model string, doc_id string, field string"))
    return run_eval(spec, gold, runs, verdicts.select("k.model", "k.doc_id", "k.field", "correct"))


def document_view(doc_id: str, documents: DataFrame, spec: DataFrame, gold: DataFrame, scores: DataFrame, strategies: Sequence[str] = retrieval.STRATEGIES) -> dict[str, DataFrame]:
    """What a page on one document shows: its text, its fields with golden values, and its queries with each strategy's hit and MRR."""
    here = F.col("doc_id") == doc_id
    return {
        "source": documents.where(here),
        "fields": spec.where(here).join(gold.withColumnRenamed("value", "gold"), ["doc_id", "field"], "left").select("field_ix", "field", "type", "description", F.to_json("gold").alias("gold")),
        "queries": evaluation.by_strategy(scores.where(here), list(strategies)).join(scores.where(here).select("query_id", "question").distinct(), "query_id"),
    }


def scorecard(fields: DataFrame, docs: DataFrame, models: DataFrame, retrieval_report: DataFrame) -> dict[str, DataFrame]:
    """What the scorecard's page shows, in its order: models by F1, the retrieval report's overall rows, each document's best model
    and correct fields by model, and the documents."""
    best = docs.groupBy("doc_id").agg(F.max_by("model", F.struct("f1", "n_correct")).alias("best_model"), F.max("f1").alias("best_f1"), F.count(F.lit(1)).alias("n_models"))
    kinds = fields.groupBy("doc_id").agg(F.count_distinct("field").alias("n_fields"))
    return {
        "models": models.withColumn("band", band(F.col("f1"))).orderBy(F.desc("f1"), "model"),
        "retrieval": retrieval_report.where("doc_id IS NULL").drop("doc_id").orderBy("strategy"),
        "retrieval_by_document": retrieval_report.where("doc_id IS NOT NULL").orderBy("strategy", "doc_id"),
        "documents": best.join(kinds, "doc_id").orderBy("doc_id"),
        "correct": docs.select("doc_id", "model", "n_correct", "n_fields").orderBy("doc_id", "model"),
    }


def model_view(model: str, fields: DataFrame) -> DataFrame:
    """A model's scored fields, by document; the model is found by its own name, as file names aren't one to one."""
    return fields.where(F.col("model") == model).select("doc_id", "field_ix", "field", "category", "correct", "f1")


def _failed(runs: DataFrame) -> DataFrame:
    """Documents whose call failed score as documents without any value."""
    return runs.where("field IS NULL").select("model", "doc_id", F.lit("").alias("field"), "value")


def run_summary(runs: DataFrame) -> DataFrame:
    """(model, doc_id, failed, n_fields, n_null) for each document of each run."""
    return runs.groupBy("model", "doc_id").agg(
        F.bool_or(F.col("error").isNotNull()).alias("failed"), F.count("field").alias("n_fields"), F.count_if(F.col("field").isNotNull() & F.col("value").isNull()).alias("n_null")
    )


def run_live(documents: DataFrame, spec: DataFrame, gold: DataFrame, chat: extraction.Chat, model: str, doc_id: str, retry: extraction.Retry = extraction.Retry()) -> DataFrame:
    """One document extracted now: (field, predicted, gold, equal, correct, error); equal compares JSON texts strictly.

    KeyError for a document without text or field specification.
    """
    one, fields = documents.where(F.col("doc_id") == doc_id), spec.where(F.col("doc_id") == doc_id)
    if not one.limit(1).count() or not fields.limit(1).count():
        raise KeyError(doc_id)
    answers = extraction.extract(one, fields, chat, model, retry=retry)
    runs = extraction.to_fields(answers, fields)
    pairs = scoring.score_fields(scoring.field_pairs(fields, gold, runs)).select("doc_id", "field", "field_ix", "score.correct")
    both = runs.withColumnRenamed("value", "predicted").join(gold.withColumnRenamed("value", "gold"), ["doc_id", "field"], "left")
    compared = both.join(pairs, ["doc_id", "field"]).join(answers.select("doc_id", "error"), "doc_id")
    return compared.select("field_ix", "field", F.to_json("predicted").alias("predicted"), F.to_json("gold").alias("gold"), scoring.strictly_equal(F.col("predicted"), F.col("gold")).alias("equal"), "correct", "error")
