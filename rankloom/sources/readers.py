"""Sources: documents, golden data, field specifications, runs, baselines and embedding caches as DataFrames.

Paths go to Spark's readers only, so they can lie in any store that Spark reads. A file's document is its
directory's name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import parsed_json

QUERY_FIELDS = "id: string, question: string, expected_spans: array<struct<section: string, quote: string>>, rationale: string"


def _directory() -> Column:
    return F.element_at(F.split(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "/"), -2)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _whole(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, path, text) of whole files; no rows if nothing matches."""
    try:
        files = spark.read.text(pattern, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return _empty(spark, "doc_id string, path string, text string")
    return files.select(_directory().alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def documents(spark: SparkSession, root: str, name: str = "source.md") -> DataFrame:
    return _whole(spark, f"{root}/*/{name}").select("doc_id", "text")


def document_stream(spark: SparkSession, root: str, files: int, name: str = "source.md") -> DataFrame:
    """A stream of (doc_id, text) of whole files, in micro-batches of so many."""
    texts = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files).load(f"{root}/*/{name}")
    return texts.select(_directory().alias("doc_id"), F.col("value").alias("text"))


def listed(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """(doc_id) of directories that have all files named, in order of name; contents aren't read."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*/*").select("path")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return _empty(spark, "doc_id string")
    parts = F.split("path", "/")
    found = files.select(F.element_at(parts, -2).alias("doc_id"), F.element_at(parts, -1).alias("name")).where(F.col("name").isin(*names))
    return found.groupBy("doc_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(set(names))).select("doc_id").orderBy("doc_id")


def prompts(spark: SparkSession, root: str, names: tuple[str, ...] = ("system", "judge")) -> dict[str, str]:
    """Prompt texts by name, of files <name>.txt or <name>.md; a few short files, read on the driver. Missing ones are left out."""
    found = _whole(spark, f"{root}/*.{{txt,md}}").select(F.regexp_extract("path", r"([^/]+)\.(?:txt|md)$", 1).alias("name"), "text")
    return {r.name: r.text.strip() for r in found.where(F.col("name").isin(*names)).collect()}


def golden_queries(spark: SparkSession, root: str, name: str = "retrieval.json") -> DataFrame:
    """(doc_id, query_id, question, expected_spans, rationale); documents without the file have no rows."""
    rows = _whole(spark, f"{root}/*/{name}").select("doc_id", F.explode(F.from_json("text", f"array<struct<{QUERY_FIELDS}>>")).alias("q"))
    return rows.select("doc_id", F.col("q.id").alias("query_id"), "q.question", "q.expected_spans", "q.rationale")


def spans(queries: DataFrame) -> DataFrame:
    """(query_id, span_ix, section, quote) of golden queries."""
    return queries.select("query_id", F.posexplode("expected_spans").alias("span_ix", "s")).select("query_id", "span_ix", "s.section", "s.quote")


def fields_of(text: Column) -> Column:
    """A JSON object as map<string, variant>."""
    return F.from_json(text, "map<string,variant>")


def _not_null(v: Column) -> Column:
    """A JSON null counts as a missing value."""
    return F.when(~F.is_variant_null(v), v)


def golden_texts(spark: SparkSession, root: str, name: str = "golden.json") -> DataFrame:
    """(doc_id, text) of golden records as they are stored."""
    return _whole(spark, f"{root}/*/{name}").select("doc_id", "text")


def whole_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(text) of whole files."""
    return _whole(spark, pattern).select("text")


def golden_records(spark: SparkSession, root: str, name: str = "golden.json") -> DataFrame:
    """Long rows (doc_id, field, value VARIANT)."""
    rows = _whole(spark, f"{root}/*/{name}").select("doc_id", F.explode(fields_of(F.col("text"))).alias("field", "value"))
    return rows.select("doc_id", "field", _not_null(F.col("value")).alias("value"))


def missing_golden(records: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted documents without golden data (a stated, short list)."""
    have = {r.doc_id for r in records.select("doc_id").distinct().where(F.col("doc_id").isin(*wanted)).collect()}
    return sorted(set(wanted) - have)


def field_spec(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, field, field_ix, type, description, item_type, valid_values, tol_abs, tol_pct, subfields), in the schema's order."""
    # from_json keeps an object's order; VARIANT sorts keys.
    kind = "type: string, description: string, item_type: string, valid_values: array<string>, tolerance: struct<abs: double, pct: double>, fields: map<string, string>"
    texts = _whole(spark, path).select(F.explode(F.from_json("text", f"struct<documents: array<struct<doc_id: string, fields: map<string, struct<{kind}>>>>>")["documents"]).alias("d"))
    rows = texts.select("d.doc_id", F.posexplode(F.map_entries("d.fields")).alias("field_ix", "e"))
    return rows.select(
        "doc_id", F.col("e.key").alias("field"), "field_ix", F.coalesce("e.value.type", F.lit("string")).alias("type"), "e.value.description", F.coalesce("e.value.item_type", F.lit("string")).alias("item_type"),
        "e.value.valid_values", F.col("e.value.tolerance.abs").alias("tol_abs"), F.col("e.value.tolerance.pct").alias("tol_pct"), F.coalesce("e.value.fields", F.expr("map()").cast("map<string,string>")).alias("subfields"),
    )


def runs(spark: SparkSession, pattern: str, seen: Observation | None = None) -> DataFrame:
    """Long rows (model, created_at, doc_id, field, value VARIANT, error, error_type) of run files.

    Files that are no JSON objects with a model are skipped; a document whose call failed has one row
    with a null field and its error. seen gets the numbers of `files` and of those `skipped` when the result is read.
    """
    whole = _whole(spark, pattern).select(F.from_json("text", "struct<model: string, created_at: string, extractions: map<string, map<string, variant>>>").alias("r"))
    good = F.coalesce(F.col("r.model").isNotNull(), F.lit(False))
    parsed = _observed(whole, seen, "files", good).where(good)
    docs = parsed.select("r.model", F.try_to_timestamp("r.created_at").alias("created_at"), F.explode("r.extractions").alias("doc_id", "entries"))
    text = lambda k: F.try_variant_get(F.try_element_at("entries", F.lit(k)), "$", "string")
    rows = docs.select("model", "created_at", "doc_id", text("_error").alias("error"), text("_error_type").alias("error_type"), F.explode_outer(F.map_filter("entries", lambda k, v: ~k.isin("_error", "_error_type"))).alias("field", "value"))
    return rows.select("model", "created_at", "doc_id", "field", _not_null(F.col("value")).alias("value"), "error", "error_type")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(model, precision, recall, f1, n_documents); no rows if there is no file."""
    rows = _whole(spark, path).select(F.explode(F.from_json("text", "map<string, struct<precision: double, recall: double, f1: double, n_documents: int>>")).alias("model", "b"))
    return rows.select("model", "b.*")


def embedding_cache(spark: SparkSession, path: str, model: str, seen: Observation | None = None) -> DataFrame:
    """(model, h, v) of JSON lines {"model", "h", "v"} of a model; of several for a text the last holds.

    Lines without a model, as other tools write them, are taken for the model that is asked for. Bad lines are skipped; seen
    gets the numbers of `lines` (but for empty ones) and of those `skipped` when the result is read.
    """
    lines = _whole(spark, path).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    rows = lines.select("path", "pos", F.from_json("line", "struct<model: string, h: string, v: array<double>>").alias("r"))
    good = F.coalesce(F.col("r.h").isNotNull() & F.col("r.v").isNotNull(), F.lit(False))
    rows = _observed(rows, seen, "lines", good).where(good).where(F.coalesce("r.model", F.lit(model)) == model)
    return rows.groupBy(F.col("r.h").alias("h")).agg(F.max_by("r.v", F.struct("path", "pos")).alias("v")).select(F.lit(model).alias("model"), "h", "v")


def _observed(rows: DataFrame, seen: Observation | None, name: str, good: Column) -> DataFrame:
    """rows, with their number and that of those that aren't good counted on the way."""
    return rows if seen is None else rows.observe(seen, F.count(F.lit(1)).alias(name), F.count_if(~good).alias("skipped"))


def artifact_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, text) of a viewer's text files; no rows if nothing is there."""
    return _whole(spark, pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "text")


def artifact_values(spark: SparkSession, pattern: str, seen: Observation | None = None) -> DataFrame:
    """(path, name, value VARIANT) of a viewer's JSON files: null for one that is no JSON; no rows if nothing is there.

    seen gets the numbers of `files` and of those that are `skipped` (null) when the result is read.
    """
    rows = artifact_texts(spark, pattern).select("path", "name", parsed_json("text").alias("value"))
    return _observed(rows, seen, "files", F.col("value").isNotNull())


def artifact_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files that match, in order; none if the folder isn't there. Contents aren't read."""
    try:
        files = spark.read.format("binaryFile").load(pattern).select("path")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [r.name for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("name").collect()]
