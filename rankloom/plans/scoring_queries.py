"""Scoring queries: golden values are columns, predictions are columns changed by a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import scoring as S
from rankloom.plans.registry import Registry, table
from rankloom.streaming.drift import rolling_hit_rate

R = Registry()


@R.add("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN true WHEN 1 THEN abs(l_quantity - (l_quantity + 0.8::DOUBLE)) <= 1
  WHEN 2 THEN abs(l_quantity - l_quantity * 1.05::DOUBLE) <= 1 OR abs(l_quantity - l_quantity * 1.05::DOUBLE) <= 0.05::DOUBLE * abs(l_quantity) ELSE false END AS correct FROM lineitem""")
def score_numeric(spark, d):
    """Predictions: equal with commas, 0.8 off, 5 % off, "12d" and missing."""
    li = table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 5
    q = F.col("l_quantity")
    off = F.when(k == 0, F.concat(F.lit(" "), F.format_number(q, 2))).when(k == 1, (q + 0.8).cast("string")).when(k == 2, (q * 1.05).cast("string")).when(k == 3, F.lit("12d"))
    return li.select("l_orderkey", "l_linenumber", S.numeric_correct(S.value_of_number(q), S.value_of_string(off)).alias("correct"))


@R.add("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN g WHEN 1 THEN NOT g WHEN 2 THEN g WHEN 3 THEN NOT g WHEN 4 THEN false ELSE false END AS correct FROM (SELECT c_custkey, c_acctbal > 0 AS g FROM customer)""")
def score_boolean(spark, d):
    c = table(spark, d, "customer")
    said = F.element_at(F.array(F.lit("yes"), F.lit("No"), F.lit(" TRUE "), F.lit("0"), F.lit(""), F.lit("maybe")), (F.col("c_custkey") % 6 + 1).cast("int"))
    return c.select("c_custkey", S.boolean_correct(S.value_of_boolean(F.col("c_acctbal") > 0), S.value_of_string(said)).alias("correct"))


@R.add("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN false WHEN 5 THEN strftime(o_orderdate, '%d') = '01' ELSE true END AS correct FROM orders")
def score_date(spark, d):
    """Predictions: the whole date, year and month, the year, with a time after it, another year, the first of the month."""
    o, day = table(spark, d, "orders"), lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 6
    said = F.when(k == 0, day("yyyy-MM-dd")).when(k == 1, day("yyyy-MM")).when(k == 2, day("yyyy")).when(k == 3, F.concat(day("yyyy-MM-dd"), F.lit("T00:00"))).when(k == 4, F.concat(F.lit("1066-"), day("MM-dd"))).otherwise(F.concat(day("yyyy-MM"), F.lit("-01")))
    return o.select("o_orderkey", S.date_correct(S.value_of_string(day("yyyy-MM-dd")), S.value_of_string(said)).alias("correct"))


@R.add("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN o_orderpriority = '5-LOW' WHEN 3 THEN false ELSE true END AS correct FROM orders")
def score_categorical(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.lower("o_orderpriority")).when(k == 1, F.regexp_replace("o_orderpriority", "[- ]", "_ ")).when(k == 2, F.lit("5 low"))
    return o.select("o_orderkey", S.categorical_correct(S.value_of_string(F.col("o_orderpriority")), S.value_of_string(said)).alias("correct"))


@R.add("SELECT p_partkey, p_partkey % 3 <> 2 AS correct FROM part")
def score_string(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 3
    said = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("\t "), F.replace("p_name", F.lit(" "), F.lit("  \n")))).otherwise(F.concat("p_name", F.lit(".")))
    return p.select("p_partkey", S.string_correct(S.value_of_string(F.col("p_name")), S.value_of_string(said)).alias("correct"))


def _order_lists(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: T.categorical(x["l_returnflag"])).alias("g"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.lower("l_linestatus")).alias("v")))), lambda x: T.categorical(x["v"])).alias("p"))


@R.add("""WITH k AS (SELECT l_orderkey, lower(l_returnflag) AS g, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE lower(l_linestatus) END AS p FROM lineitem),
gc AS (SELECT l_orderkey, g AS key, count(*) AS n FROM k GROUP BY ALL), pc AS (SELECT l_orderkey, p AS key, count(*) AS n FROM k GROUP BY ALL),
m AS (SELECT l_orderkey, CAST(sum(least(gc.n, pc.n)) AS BIGINT) AS matched FROM gc JOIN pc USING (l_orderkey, key) GROUP BY l_orderkey), t AS (SELECT l_orderkey, count(*) AS n FROM k GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(matched, 0) = n AS correct, round(coalesce(matched, 0) / n, 4) AS precision, round(coalesce(matched, 0) / n, 4) AS recall, round(coalesce(matched, 0) / n, 4) AS f1 FROM t LEFT JOIN m USING (l_orderkey)""")
def score_list(spark, d):
    return _order_lists(spark, d).select("l_orderkey", F.inline(F.array(S.list_scores(F.col("g"), F.col("p")))))


@R.add("SELECT item_id, item_id % 2 = 0 AS correct FROM benchmark")
def score_free_text_fallback(spark, d):
    """Without a judge free text is scored as a string."""
    b = table(spark, d, "benchmark")
    said = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("  "), "text", F.lit("\n"))).otherwise(F.concat("text", F.lit(" more")))
    empty, none = F.expr("cast(map() AS map<string,string>)"), F.lit(None).cast("double")
    pairs = b.select("item_id", F.lit("free_text").alias("category"), F.lit("string").alias("item_type"), empty.alias("subfields"), none.alias("tol_abs"), none.alias("tol_pct"), S.value_of_string(F.col("text")).alias("gold"), S.value_of_string(said).alias("predicted"))
    return S.score_fields(pairs).select("item_id", "score.correct")


def _part_pairs(spark, d) -> DataFrame:
    """Four fields of each part, predicted by two models: one errs on every 5th key, the other on every 3rd."""
    p = table(spark, d, "part")
    empty = F.expr("cast(map() AS map<string,string>)")

    def field(name: str, category: str, gold: Column, said: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(category).alias("category"), gold.alias("gold"), said.alias("predicted"))

    rows = p.select("*", F.explode(F.array(F.struct(F.lit("m5").alias("model"), F.lit(5).alias("every")), F.struct(F.lit("m3").alias("model"), F.lit(3).alias("every")))).alias("m"))
    wrong = F.col("p_partkey") % F.col("m.every") == 0
    text = S.value_of_string
    fields = F.array(
        field("size", "numeric", S.value_of_number(F.col("p_size")), text(F.when(wrong, F.lit("many")).otherwise(F.col("p_size").cast("string")))),
        field("brand", "categorical", text(F.col("p_brand")), text(F.when(~wrong, F.lower("p_brand")))),
        field("name", "string", text(F.col("p_name")), text(F.concat(F.lit(" "), "p_name"))),
        field("dear", "boolean", S.value_of_boolean(F.col("p_retailprice") > 1000), text(F.when(F.col("p_retailprice") > 1000, "yes").otherwise("no"))),
    )
    return rows.select(F.col("m.model").alias("model"), F.col("p_partkey").alias("doc_id"), F.inline(fields)).withColumns({"item_type": F.lit("string"), "subfields": empty, "tol_abs": F.lit(0.0), "tol_pct": F.lit(0.0)})


def _part_scores(spark, d) -> DataFrame:
    return S.score_fields(_part_pairs(spark, d)).select("model", "doc_id", "field", "category", "score.*")


_SQL_PARTS = """WITH f AS (SELECT model, p_partkey AS doc_id, field, category, NOT (p_partkey % every = 0 AND field IN ('size', 'brand')) AS correct
  FROM part, (VALUES ('m5', 5), ('m3', 3)) m(model, every), (VALUES ('size', 'numeric'), ('brand', 'categorical'), ('name', 'string'), ('dear', 'boolean')) t(field, category)),
docs AS (SELECT model, doc_id, round(avg(CAST(correct AS DOUBLE)), 4) AS f1, count(*) AS n_fields, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS n_correct FROM f GROUP BY ALL),
models AS (SELECT model, round(avg(f1), 4) AS f1, count(*) AS n_documents FROM docs GROUP BY model)"""


@R.add(f"{_SQL_PARTS} SELECT model, doc_id, field, category, correct, CAST(correct AS DOUBLE) AS f1 FROM f")
def score_field_dispatch(spark, d):
    return _part_scores(spark, d).select("model", "doc_id", "field", "category", "correct", "f1")


@R.add(f"{_SQL_PARTS} SELECT model, doc_id, f1 AS precision, f1 AS recall, f1, n_fields, n_correct FROM docs")
def doc_scorecard(spark, d):
    return S.document_scores(_part_scores(spark, d))


@R.add(f"{_SQL_PARTS} SELECT model, f1 AS precision, f1 AS recall, f1, n_documents FROM models")
def model_scorecard(spark, d):
    return S.model_scores(S.document_scores(_part_scores(spark, d)))


@R.add(f"{_SQL_PARTS} SELECT model, category, field, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS n_correct, count(*) AS n FROM f GROUP BY ALL")
def field_correct_counts(spark, d):
    return _part_scores(spark, d).groupBy("model", "category", "field").agg(F.count_if("correct").alias("n_correct"), F.count(F.lit(1)).alias("n"))


@R.add("""SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM (
  SELECT label, CAST(sum(CASE WHEN gold = label AND said = label THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN gold <> label AND said = label THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN gold = label AND said <> label THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM (SELECT toxic AS gold, CASE WHEN quality = 0 THEN 1 ELSE toxic END AS said FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL), (VALUES (0), (1)) c(label) GROUP BY label)""")
def classification_prf(spark, d):
    rows = table(spark, d, "labels").where("toxic IS NOT NULL AND quality IS NOT NULL").select(F.col("toxic").alias("gold"), F.when(F.col("quality") == 0, 1).otherwise(F.col("toxic")).alias("said"))
    each = rows.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
    g, s = F.col("gold") == F.col("label"), F.col("said") == F.col("label")
    n = each.groupBy("label").agg(F.count_if(g & s).alias("tp"), F.count_if(~g & s).alias("fp"), F.count_if(g & ~s).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("label", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(T.f1(p, r), 4).alias("f1"))


def _cards(spark, d) -> tuple[DataFrame, DataFrame]:
    """Current: share of customers with money, by segment. Baseline: with over 500, but none of one segment."""
    c = table(spark, d, "customer")
    card = lambda rows, low: rows.groupBy(F.col("c_mktsegment").alias("model")).agg(F.round(F.avg((F.col("c_acctbal") > low).cast("double")), 4).alias("f1"))
    return card(c, 700), card(c.where("c_mktsegment <> 'BUILDING'"), 500)


_SQL_CARDS = "WITH cur AS (SELECT c_mktsegment AS model, round(avg(CAST(c_acctbal > 700 AS DOUBLE)), 4) AS f1 FROM customer GROUP BY 1), base AS (SELECT c_mktsegment AS model, round(avg(CAST(c_acctbal > 500 AS DOUBLE)), 4) AS f1 FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)"


@R.add(f"{_SQL_CARDS} SELECT model, coalesce(cur.f1 - base.f1 >= -0.03::DOUBLE, true) AS pass, cur.f1 AS current_f1, base.f1 AS baseline_f1, round(cur.f1 - base.f1, 4) AS delta, CASE WHEN base.f1 IS NULL THEN 'no baseline' END AS note FROM cur LEFT JOIN base USING (model)")
def regression_gate(spark, d):
    return S.gate(*_cards(spark, d))


@R.add(f"{_SQL_CARDS} SELECT model, true AS pass, f1 AS current_f1, CAST(NULL AS DOUBLE) AS baseline_f1, CAST(NULL AS DOUBLE) AS delta, 'no baseline' AS note FROM cur")
def gate_missing_baseline(spark, d):
    current, base = _cards(spark, d)
    return S.gate(current, base.where("false"))


@R.add(f"{_SQL_CARDS} SELECT model FROM cur ANTI JOIN base USING (model)")
def baseline_needs_update(spark, d):
    return S.baseline_is_stale(*_cards(spark, d))


@R.add("SELECT lang, source, count(*) AS n, CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, CAST(sum(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source")
def null_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality").isNull()).alias("n_null"), F.count_if(F.col("quality").isNotNull()).alias("n_ok"))


@R.add("SELECT event_id, event_id % 4 <> 1 AS equal FROM events")
def json_strict_compare(spark, d):
    """Strict equality looks at the order of items; spaces don't count."""
    e = table(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    a = F.concat(F.lit('{"k": '), k, F.lit(', "l": [1, 2]}'))
    b = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"k":'), k, F.lit(',"l":[2,1]}'))).otherwise(F.concat(F.lit('{ "l":[1,2], "k":'), k, F.lit("}")))
    return e.select("event_id", S.strictly_equal(F.parse_json(a), F.parse_json(b)).alias("equal"))


@R.add("SELECT date_trunc('day', ts) AS day, event_type AS strategy, round(avg(CAST(value > 50 AS DOUBLE)), 4) AS hit_rate, count(*) AS n FROM events GROUP BY ALL")
def rolling_hits(spark, d):
    e = table(spark, d, "events").select("ts", F.col("event_type").alias("strategy"), (F.col("value") > 50).alias("hit"), F.col("value").alias("mrr"))
    return rolling_hit_rate(e, window="1 day", slide="1 day").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "strategy", F.round("hit_rate", 4).alias("hit_rate"), "n")
