"""Queries through files: the tables are written by sinks as documents, golden data, runs, caches and baselines, and read by sources.

A nation is a document: its customers' names are the text, its figures the golden record, and so on. So files grow with the
customers, and SQL over the same tables says what has to come back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.functions.text import file_name_of, text_hash
from rankloom.operators import evaluation, extraction, scoring, validation
from rankloom.plans import pipelines
from rankloom.plans.registry import Registry, table
from rankloom.sources import readers, sinks
from rankloom.sources.vector_cache import VectorCache

R = Registry()


def _nations(spark, d) -> DataFrame:
    """(doc_id, name, lines, n, segments, rich) of each nation with customers; lines: its customers' names in order of their keys."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ordered = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))
    grouped = c.groupBy("n_nationkey", "n_name").agg(
        F.transform(ordered, lambda x: x["c_name"]).alias("lines"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"), (F.max("c_acctbal") > 9000).alias("rich")
    )
    return grouped.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.col("n_name").alias("name"), "lines", "n", "segments", "rich")


_SQL_NATIONS = """nations AS (SELECT 'n' || n_nationkey AS doc_id, n_name AS name, list(c_name ORDER BY c_custkey) AS lines, count(*) AS n, list_sort(list(DISTINCT c_mktsegment)) AS segments, max(c_acctbal) > 9000 AS rich
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name)"""


def _files(df: DataFrame, value: F.Column, tag: str) -> str:
    """One file a document with a text, in a folder a document; the path of the folders' folder."""
    path = storage.fresh_path(df.sparkSession, tag)
    df.select("doc_id", value.alias("value")).write.partitionBy("doc_id").text(path)
    return path


def _named(rows: DataFrame) -> DataFrame:
    """Folders' names without what Spark puts before them."""
    return rows.withColumn("doc_id", F.replace("doc_id", F.lit("doc_id="), F.lit("")))


def _texts(spark, d) -> DataFrame:
    path = _files(_nations(spark, d), F.concat(F.lit("# "), "name", F.lit("\n## Customers\n"), F.array_join("lines", "\n")), "sources")
    return _named(readers.documents(spark, path, "*"))


@R.add(f"WITH {_SQL_NATIONS} SELECT doc_id, length(t) AS n_chars, sha256(t) AS h FROM (SELECT doc_id, '# ' || name || chr(10) || '## Customers' || chr(10) || array_to_string(lines, chr(10)) || chr(10) AS t FROM nations)")
def source_documents(spark, d):
    return _texts(spark, d).select("doc_id", F.length("text").cast("long").alias("n_chars"), text_hash("text").alias("h"))


def _questions(spark, d) -> DataFrame:
    span = lambda i: F.struct(F.lit("Customers").alias("section"), F.element_at("lines", i).alias("quote"))
    one = lambda n, spans: F.struct(F.concat("doc_id", F.lit(f"-{n}")).alias("id"), F.concat(F.lit("Who is in "), "name", F.lit("?")).alias("question"), F.array(*spans).alias("expected_spans"), F.lit("r").alias("rationale"))
    return _named(readers.golden_queries(spark, _files(_nations(spark, d), F.to_json(F.array(one(1, [span(1)]), one(2, [span(1), span(-1)]))), "questions"), "*"))


@R.add(f"""WITH {_SQL_NATIONS}, q AS (SELECT doc_id, doc_id || '-1' AS query_id, 0 AS span_ix, lines[1] AS quote FROM nations
  UNION ALL SELECT doc_id, doc_id || '-2', 0, lines[1] FROM nations UNION ALL SELECT doc_id, doc_id || '-2', 1, lines[-1] FROM nations)
SELECT query_id, CAST(span_ix AS BIGINT) AS span_ix, 'Customers' AS section, quote FROM q""")
def source_golden_queries(spark, d):
    return readers.spans(_questions(spark, d)).withColumn("span_ix", F.col("span_ix").cast("long"))


def _golden(spark, d) -> DataFrame:
    record = F.struct(F.col("name").alias("nation"), F.col("n").alias("customers"), "segments", "rich", F.lit(None).cast("string").alias("nothing"))
    return _named(readers.golden_records(spark, _files(_nations(spark, d), F.to_json(record, {"ignoreNullFields": "false"}), "golden"), "*"))


@R.add(f"""WITH {_SQL_NATIONS} SELECT doc_id, 'nation' AS field, '"' || name || '"' AS value FROM nations UNION ALL SELECT doc_id, 'customers', CAST(n AS VARCHAR) FROM nations
UNION ALL SELECT doc_id, 'segments', '["' || array_to_string(segments, '","') || '"]' FROM nations UNION ALL SELECT doc_id, 'rich', CAST(rich AS VARCHAR) FROM nations UNION ALL SELECT doc_id, 'nothing', NULL FROM nations""")
def source_golden_records(spark, d):
    return _golden(spark, d).select("doc_id", "field", F.to_json("value").alias("value"))


_KINDS = {"nation": {"type": "string", "description": "name"}, "customers": {"type": "integer", "description": "count", "tolerance": {"abs": 2, "pct": 0.0}}, "segments": {"type": "list", "description": "all"}, "rich": {"type": "boolean", "description": "any"}, "nothing": {"type": "string", "description": "none"}}


def _spec(spark, d) -> DataFrame:
    """Every nation's fields, as one file in the order of the names."""
    path = storage.fresh_path(spark, "spec")
    docs = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('{"doc_id": "'), "doc_id", F.lit(f'", "fields": {json.dumps(_KINDS)}}}')))), ",")
    _nations(spark, d).agg(F.concat(F.lit('{"documents": ['), docs, F.lit("]}")).alias("value")).write.text(path)  # a row a nation
    return readers.field_spec(spark, f"{path}/*")


@R.add(f"""WITH {_SQL_NATIONS} SELECT doc_id, field, CAST(ix AS BIGINT) AS field_ix, type, tol_abs FROM nations,
  (VALUES ('nation', 0, 'string', NULL), ('customers', 1, 'integer', 2.0), ('segments', 2, 'list', NULL), ('rich', 3, 'boolean', NULL), ('nothing', 4, 'string', NULL)) v(field, ix, type, tol_abs)""")
def source_field_spec(spark, d):
    return _spec(spark, d).select("doc_id", "field", F.col("field_ix").cast("long").alias("field_ix"), "type", "tol_abs")


def _run_files(spark, d) -> str:
    """Runs of two models as files: right for every nation but for deviations, an error, a file that is no JSON and one without a model."""
    said = F.struct(F.when(F.col("n") % 3 == 0, F.lower("name")).otherwise(F.concat("name", F.lit("x"))).alias("nation"), (F.col("n") + 3 * F.col("rich").cast("long")).alias("customers"), F.reverse("segments").alias("segments"), F.col("rich").cast("string").alias("rich"))
    failed = F.col("n") % 4 == 0
    one = F.concat(F.lit('"'), "doc_id", F.lit('": '), F.when(failed, F.lit('{"_error": "timeout", "_error_type": "ModelError"}')).otherwise(F.to_json(said)))
    whole = F.concat(F.lit('{"model": "m:1", "created_at": "2026-01-02T03:04:05", "extractions": {'), F.array_join(F.array_sort(F.collect_list(one)), ","), F.lit("}}"))
    path = storage.fresh_path(spark, "runs")
    nations = _nations(spark, d)
    good = nations.agg(whole.alias("value")).select("value", file_name_of(F.lit("m:1")).alias("file"))  # a row a nation
    two = good.select(F.replace("value", F.lit('"m:1"'), F.lit('"m/1"')).alias("value"), F.lit("second").alias("file"))
    bad = nations.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(F.struct(F.lit('{"model": ').alias("value"), F.lit("broken").alias("file")), F.struct(F.lit("{}").alias("value"), F.lit("nameless").alias("file")))).alias("x")).select("x.*")
    good.unionByName(two).unionByName(bad).write.partitionBy("file").text(path)
    return f"{path}/*/*"


_SQL_RUNS = """models AS (SELECT unnest(['m:1', 'm/1']) AS model), said AS (SELECT doc_id, n % 4 = 0 AS failed, CASE WHEN n % 3 = 0 THEN lower(name) ELSE name || 'x' END AS nation, n + CASE WHEN rich THEN 3 ELSE 0 END AS customers, list_reverse(segments) AS segments, rich FROM nations)"""


@R.add(f"""WITH {_SQL_NATIONS}, {_SQL_RUNS} SELECT model, doc_id, NULL AS field, NULL AS value, 'timeout' AS error, 'ModelError' AS error_type FROM models, said WHERE failed
UNION ALL SELECT model, doc_id, unnest(['nation', 'customers', 'segments', 'rich']), unnest(['"' || nation || '"', CAST(customers AS VARCHAR), '["' || array_to_string(segments, '","') || '"]', '"' || rich || '"']), NULL, NULL FROM models, said WHERE NOT failed""")
def source_runs(spark, d):
    """Two models whose file names would be one are told apart; bad files are skipped."""
    return readers.runs(spark, _run_files(spark, d)).select("model", "doc_id", "field", F.to_json("value").alias("value"), "error", "error_type")


@R.add("SELECT CAST(4 AS BIGINT) AS files, CAST(2 AS BIGINT) AS skipped, count(DISTINCT c_nationkey) AS n_documents FROM customer")
def source_runs_skipped(spark, d):
    seen = Observation("run files")
    n = readers.runs(spark, _run_files(spark, d), seen).agg(F.count_distinct("doc_id").alias("n_documents")).persist()
    n.count()
    return n.select(F.lit(seen.get["files"]).cast("long").alias("files"), F.lit(seen.get["skipped"]).cast("long").alias("skipped"), "n_documents")


@R.add(f"WITH {_SQL_NATIONS}, {_SQL_RUNS} SELECT model, doc_id, failed, CASE WHEN failed THEN 0 ELSE 4 END AS n_fields, CAST(0 AS BIGINT) AS n_null FROM models, said")
def run_validation(spark, d):
    return pipelines.run_summary(readers.runs(spark, _run_files(spark, d)))


_SQL_SCORED = f"""{_SQL_NATIONS}, {_SQL_RUNS}, f AS (SELECT model, doc_id, failed,
  CASE WHEN NOT failed AND lower(nation) = lower(name) THEN 1.0 ELSE 0 END AS s1, CASE WHEN NOT failed AND customers <= n + 2 THEN 1.0 ELSE 0 END AS s2, CASE WHEN NOT failed THEN 1.0 ELSE 0 END AS s3, 1.0 AS s5 FROM models JOIN said ON true JOIN nations USING (doc_id)),
docs AS (SELECT model, doc_id, round((s1 + s2 + s3 + s3 + s5) / 5, 4) AS f1, CAST(s1 + s2 + s3 + s3 + s5 AS BIGINT) AS n_correct FROM f)"""


def _scored(spark, d):
    return pipelines.run_eval(_spec(spark, d), _golden(spark, d), readers.runs(spark, _run_files(spark, d)))


@R.add(f"WITH {_SQL_SCORED} SELECT model, doc_id, f1, n_correct FROM docs")
def eval_runs_by_document(spark, d):
    """Runs, golden records and specification from files; failed documents score as documents without values."""
    return _scored(spark, d)[1].select("model", "doc_id", "f1", "n_correct")


@R.add(f"WITH {_SQL_SCORED} SELECT model, round(avg(f1), 4) AS f1, count(*) AS n_documents FROM docs GROUP BY model UNION ALL SELECT 'gone', 0.0, 0")
def eval_failed_model(spark, d):
    return pipelines.failed_models(_scored(spark, d)[2], ["m:1", "gone"]).select("model", "f1", "n_documents")


@R.add(f"WITH {_SQL_SCORED} SELECT doc_id, max(f1) AS best_f1, count(*) AS n_models, CAST(5 AS BIGINT) AS n_fields FROM docs GROUP BY doc_id")
def scorecard_documents(spark, d):
    fields, docs, models = _scored(spark, d)
    none = spark.createDataFrame([], "strategy string, doc_id string, hit_at_k double, recall_at_k double, mrr double, n_queries long")
    return pipelines.scorecard(fields, docs, models, none)["documents"].select("doc_id", "best_f1", "n_models", "n_fields")


@R.add(f"WITH {_SQL_SCORED} SELECT doc_id, 'nation' AS field, s1 = 1 AS correct FROM f WHERE model = 'm:1' UNION ALL SELECT doc_id, 'customers', s2 = 1 FROM f WHERE model = 'm:1' UNION ALL SELECT doc_id, unnest(['segments', 'rich']), s3 = 1 FROM f WHERE model = 'm:1' UNION ALL SELECT doc_id, 'nothing', true FROM f WHERE model = 'm:1'")
def model_page(spark, d):
    return pipelines.model_view("m:1", _scored(spark, d)[0]).select("doc_id", "field", "correct")


@R.add(f"WITH {_SQL_SCORED}, m AS (SELECT model, round(avg(f1), 4) AS f1, count(*) AS n_documents FROM docs GROUP BY model) SELECT model, f1, n_documents FROM m")
def baseline_snapshot(spark, d):
    """The baseline is written as there is none, read, and not written again."""
    models, path = _scored(spark, d)[2].persist(), storage.fresh_path(spark, "baseline")
    before = readers.baseline(spark, f"{path}/*")
    assert sinks.save_baseline(models, scoring.baseline_is_stale(models, before), path)
    after = readers.baseline(spark, f"{path}/*")
    assert not sinks.save_baseline(models, scoring.baseline_is_stale(models, after), path)
    return after.select("model", "f1", F.col("n_documents").cast("long").alias("n_documents"))


@R.add(f"""WITH {_SQL_NATIONS} SELECT 'm' AS model, doc_id, 'n' AS field, CAST(CASE WHEN n % 2 = 0 THEN n ELSE -n END AS VARCHAR) AS value FROM nations UNION ALL SELECT 'other', doc_id, 'n', CAST(n AS VARCHAR) FROM nations""")
def sink_runs(spark, d):
    """A second save replaces the documents that it has, of its model only."""
    path, nations = storage.fresh_path(spark, "saved-runs"), _nations(spark, d)
    row = lambda model, n: (F.lit(model).alias("model"), F.current_timestamp().alias("created_at"), "doc_id", F.lit("n").alias("field"), F.parse_json(n.cast("string")).alias("value"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_type"))
    for model in ("m", "other"):
        sinks.save_runs(nations.select(*row(model, F.col("n"))), path)
    sinks.save_runs(nations.where("n % 2 = 1").select(*row("m", -F.col("n"))), path)
    return sinks.load_runs(spark, path).select("model", "doc_id", "field", F.to_json("value").alias("value"))


@R.add("SELECT 'm1' AS model, sha256(CAST(vec_id AS VARCHAR)) AS h, round(CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id AS DOUBLE) ELSE embedding[1] END, 6) AS first FROM embeddings WHERE vec_id % 2 = 0 AND embedding[1] IS NOT NULL")
def source_cache_lines(spark, d):
    """JSON lines of two models, with broken lines and lines that come again; the last holds."""
    path = storage.fresh_path(spark, "cache-lines")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), text_hash(F.col("vec_id").cast("string")).alias("h"), F.when(F.col("vec_id") % 2 == 0, "m1").otherwise("m2").alias("model"))
    lines = vectors.where("v[0] IS NOT NULL").select("model", F.array(F.to_json(F.struct("model", "h", "v")), F.lit('{"h": '), F.lit('{"model": "m1", "h": "x"}'), F.when(F.col("vec_id") % 3 == 0, F.to_json(F.struct("model", "h", F.array(F.col("vec_id").cast("double")).alias("v"))))).alias("l"))
    lines.select(F.array_join("l", "\n").alias("value")).write.text(path)
    return readers.embedding_cache(spark, f"{path}/*", "m1").select("model", "h", F.round(F.get("v", F.lit(0)), 6).alias("first"))


@R.add("""SELECT vec_id, kind FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' WHEN vec_id % 2 = 0 THEN 'old' ELSE 'miss' END AS kind FROM embeddings) ORDER BY vec_id""")
def vector_cache_table(spark, d):
    """A table of vectors is written, appended to and compacted; other models' vectors are none of it."""
    ids = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("text"))
    cache = VectorCache(spark, storage.fresh_path(spark, "vectors"), buckets=8)
    rows = lambda df, model, value: df.select(F.lit(model).alias("model"), text_hash("text").alias("h"), F.array(F.lit(value)).alias("v"))
    cache.append(rows(ids.where("vec_id % 2 = 0"), "m", 1.0), "m")
    cache.append(rows(ids, "other", 9.0), "other")
    cache.append(rows(ids.where("vec_id % 3 = 0"), "m", 2.0), "m")
    cache.compact("m")
    held = cache.with_vectors(ids, "m").select("vec_id", F.when(F.get("v", F.lit(0)) == 2.0, "new").otherwise("old").alias("kind"))
    return held.unionByName(cache.misses(ids.select("text"), "m").select(F.col("text").cast("long").alias("vec_id"), F.lit("miss").alias("kind")))


@R.add(f"""WITH {_SQL_NATIONS} SELECT strategy AS name, CAST(2 * count(*) AS BIGINT) AS n_queries, CAST(count(*) AS BIGINT) AS n_documents, CAST(2 * count(*) AS BIGINT) AS n_rows FROM nations, (SELECT unnest(['a', 'b']) AS strategy) GROUP BY strategy""")
def sink_retrieval_report(spark, d):
    """A nested report a strategy, written as JSON and read back."""
    queries = _questions(spark, d).select("doc_id", "query_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("strategy"))
    scores = queries.select("strategy", "doc_id", "query_id", F.lit(True).alias("hit"), F.lit(1.0).alias("recall"), F.lit(0.5).alias("mrr"))
    report = evaluation.report(scores, "strategy", "doc_id").persist()
    path = storage.fresh_path(spark, "report")
    sinks.write_json(sinks.retrieval_report(report.where("doc_id IS NULL"), report.where("doc_id IS NOT NULL"), scores), path)
    back = spark.read.schema("name string, metrics struct<n_queries: long>, per_doc map<string, struct<mrr: double>>, per_query array<struct<query_id: string>>").json(path)
    return back.select("name", "metrics.n_queries", F.size("per_doc").cast("long").alias("n_documents"), F.size("per_query").cast("long").alias("n_rows"))


@R.add(f"WITH {_SQL_NATIONS} SELECT 'm' AS model, doc_id, CASE WHEN n % 3 = 0 THEN NULL ELSE n END AS customers, CASE WHEN n % 3 = 0 THEN 'BadAnswer' END AS error_type FROM nations")
def extract_with_errors(spark, d):
    """A model's answers to every document; those to a third are no JSON, and become rows with an error."""
    docs = _texts(spark, d)

    def chat(system: str, user: str) -> str:
        n = user[user.index("## Customers") :].count("\n") - 1
        return "no answer" if n % 3 == 0 else json.dumps({"customers": n})

    answers = extraction.extract(docs, _spec(spark, d), chat, "m")
    return answers.select("model", "doc_id", F.get_json_object("value", "$.customers").cast("long").alias("customers"), "error_type")


@R.add(f"WITH {_SQL_NATIONS} SELECT doc_id, lower(name) LIKE '%i%' AS correct FROM nations")
def judged_pairs(spark, d):
    """A judge decides on each nation's name."""

    def ask(system: str, user: str) -> str:
        return json.dumps({"correct": "i" in json.loads(user)["candidate"].lower(), "reason": "r"})

    pairs = _nations(spark, d).select(F.col("doc_id").alias("id"), F.lit("nation").alias("field"), F.col("name").alias("gold"), F.col("name").alias("predicted"))
    return extraction.judge(pairs, ask, "judge").select(F.col("id").alias("doc_id"), "correct")


@R.add(f"""WITH {_SQL_NATIONS}, c AS (SELECT unnest(['source_present', 'golden_present', 'has_nation', 'list_segments', 'has_missing', 'query_count', 'span_count']) AS rule, unnest(['error', 'error', 'warning', 'error', 'warning', 'error', 'warning']) AS severity, unnest([0, 0, 0, 0, 1, 1, 1]) AS bad, doc_id FROM nations)
SELECT rule, severity, count(*) AS n, CAST(sum(bad) AS BIGINT) AS n_failed FROM c GROUP BY rule, severity""")
def golden_rules(spark, d):
    """Rules on golden data that was written to files: all lack a field, and have two queries in place of five."""
    asked = _questions(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "question", "expected_spans")).alias("queries"))
    record = _named(readers.golden_texts(spark, _files(_nations(spark, d), F.to_json(F.struct(F.col("name").alias("nation"), "segments")), "golden-texts"), "*")).select("doc_id", F.parse_json("text").alias("golden"))
    rows = _texts(spark, d).join(record, "doc_id").join(asked, "doc_id")
    rules = {k: v for k, v in validation.golden_rules(["nation", "missing"], ["segments"]).items() if k in ("source_present", "golden_present", "has_nation", "list_segments", "has_missing", "query_count", "span_count")}
    return validation.summary(validation.constraints(rows, F.col("doc_id"), rules)).select("rule", "severity", "n", "n_failed")

