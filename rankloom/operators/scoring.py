"""Typed field scoring of extractions against golden values, as expressions; and the scorecards above it.

A value is struct(tag, s, d, items): tag one of null, bool, num, str, list, object; s its text, d its
number, items its list as VARIANTs. One CASE over the category scores a field; no Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import boolean, categorical, dates_match, f1, normalized, number, partial_date

TOL_ABS, TOL_PCT, GATE_TOLERANCE, DIGITS = 1.0, 0.05, 0.03, 4
#: Categories of declared types; any other type is scored as a string.
CATEGORIES = {"integer": "numeric", "number": "numeric", "float": "numeric", "boolean": "boolean", "date": "date", "categorical": "categorical", "list": "list", "free_text": "free_text", "string": "string"}
#: The keys that name an object item, in order.
ITEM_NAMES = ("label", "name", "measure")


def category_of(declared: Column) -> Column:
    return F.coalesce(*[F.when(declared == k, F.lit(v)) for k, v in CATEGORIES.items()], F.lit("string"))


def value_of_variant(v: Column) -> Column:
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    tag = (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "bool").when(kind == "STRING", "str").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("num")
    )
    return F.struct(
        tag.alias("tag"),
        F.try_variant_get(v, "$", "string").alias("s"),
        F.when(tag == "num", F.try_variant_get(v, "$", "double")).alias("d"),
        F.when(tag == "list", F.try_variant_get(v, "$", "array<variant>")).alias("items"),
    )


def _value(tag: Column, s: Column, d: Column) -> Column:
    return F.struct(tag.alias("tag"), s.alias("s"), d.cast("double").alias("d"), F.lit(None).cast("array<variant>").alias("items"))


def value_of_string(c: Column) -> Column:
    return _value(F.when(c.isNull(), "null").otherwise("str"), c, F.lit(None))


def value_of_number(c: Column) -> Column:
    return _value(F.when(c.isNull(), "null").otherwise("num"), c.cast("string"), c)


def value_of_boolean(c: Column) -> Column:
    return _value(F.when(c.isNull(), "null").otherwise("bool"), c.cast("string"), F.lit(None))


def is_null(v: Column) -> Column:
    """Null, the empty string and the empty list; not 0 and not false."""
    return (v["tag"] == "null") | ((v["tag"] == "str") & (v["s"] == "")) | ((v["tag"] == "list") & (F.coalesce(F.size(v["items"]), F.lit(0)) == 0))


def as_number(v: Column) -> Column:
    return F.when(v["tag"] == "num", v["d"]).when(v["tag"] == "str", number(v["s"]))


def as_boolean(v: Column) -> Column:
    return F.when(v["tag"] == "bool", v["s"].try_cast("boolean")).when(v["tag"] == "str", boolean(v["s"])).when((v["tag"] == "num") & v["d"].isin(0.0, 1.0), v["d"] == 1.0)


def numeric_correct(g: Column, p: Column, tol_abs: Column | float = TOL_ABS, tol_pct: Column | float = TOL_PCT) -> Column:
    a, b = as_number(g), as_number(p)
    apart = F.abs(a - b)
    # A comparison with NaN is false, but Spark orders NaN above all numbers.
    close = ~F.isnan(apart) & ((apart <= tol_abs) | (apart <= tol_pct * F.abs(a)))
    return F.when(a.isNull(), is_null(p)).when(b.isNull(), F.lit(False)).otherwise(close)


def boolean_correct(g: Column, p: Column) -> Column:
    return F.when(as_boolean(g).isNull(), is_null(p)).otherwise(F.coalesce(as_boolean(g) == as_boolean(p), F.lit(False)))


def date_correct(g: Column, p: Column) -> Column:
    a, b = partial_date(g["s"]), partial_date(p["s"])
    return F.when(a.isNull(), is_null(p)).when(b.isNull(), F.lit(False)).otherwise(dates_match(a, b))


def categorical_correct(g: Column, p: Column) -> Column:
    return F.when(categorical(g["s"]) == "", is_null(p)).otherwise(categorical(g["s"]) == categorical(p["s"]))


def string_correct(g: Column, p: Column) -> Column:
    return F.when(normalized(g["s"]) == "", is_null(p)).otherwise(normalized(g["s"]) == normalized(p["s"]))


def item_key(item: Column, item_type: Column, subfields: Column) -> Column:
    """What two list items are compared by: an object's first name that the spec has, else its canonical JSON."""
    kind = F.coalesce(F.schema_of_variant(item), F.lit("VOID"))
    text = F.try_variant_get(item, "$", "string")
    is_object = kind.startswith("OBJECT")
    # A key that is there with a null value counts as there, with an empty text.
    there = lambda k: is_object & F.coalesce(F.map_contains_key(subfields, k), F.lit(False)) & kind.rlike(rf"[<,] ?{k}: ")
    named = F.lit(None).cast("string")
    for k in reversed(ITEM_NAMES):
        named = F.when(there(k), normalized(F.try_variant_get(item, f"$.{k}", "string"))).otherwise(named)
    whole = F.when(is_object, normalized(F.to_json(item))).otherwise(normalized(text))
    return F.when(item_type == "object", F.coalesce(named, whole)).when(item_type == "categorical", categorical(text)).otherwise(normalized(text))


def item_keys(v: Column, item_type: Column, subfields: Column) -> Column:
    return F.transform(F.coalesce(v["items"], F.array().cast("array<variant>")), lambda x: item_key(x, item_type, subfields))


def matched_items(gold: Column, predicted: Column) -> Column:
    """Size of the multiset intersection of two key arrays, without empty keys: what greedy matching finds."""
    count = lambda keys, k: F.size(F.filter(keys, lambda x: x == k))
    shared = F.array_distinct(F.filter(gold, lambda k: k != ""))
    return F.aggregate(shared, F.lit(0), lambda n, k: n + F.least(count(gold, k), count(predicted, k)))


def list_scores(gold: Column, predicted: Column) -> Column:
    """struct(correct, precision, recall, f1) of key arrays; both empty is right."""
    n = matched_items(gold, predicted)
    p = F.coalesce(F.try_divide(n.cast("double"), F.size(predicted)), F.lit(0.0))
    r = F.coalesce(F.try_divide(n.cast("double"), F.size(gold)), F.lit(0.0))
    empty = (F.size(gold) == 0) & (F.size(predicted) == 0)
    one = lambda c, name: F.when(empty, F.lit(1.0)).otherwise(F.round(c, DIGITS)).alias(name)
    return F.struct((empty | ((p == 1.0) & (r == 1.0))).alias("correct"), one(p, "precision"), one(r, "recall"), one(f1(p, r), "f1"))


def scalar_scores(correct: Column) -> Column:
    one = correct.cast("double")
    return F.struct(correct.alias("correct"), one.alias("precision"), one.alias("recall"), one.alias("f1"))


def score_fields(pairs: DataFrame) -> DataFrame:
    """pairs with struct score. pairs: category, item_type, subfields, tol_abs, tol_pct, gold, predicted (values).

    Free text is scored as a string here; rows that a judge has to decide come from needs_judge().
    """
    g, p = F.col("gold"), F.col("predicted")
    scalar = (
        F.when(F.col("category") == "numeric", numeric_correct(g, p, F.coalesce("tol_abs", F.lit(TOL_ABS)), F.coalesce("tol_pct", F.lit(TOL_PCT))))
        .when(F.col("category") == "boolean", boolean_correct(g, p))
        .when(F.col("category") == "date", date_correct(g, p))
        .when(F.col("category") == "categorical", categorical_correct(g, p))
        .otherwise(string_correct(g, p))
    )
    lists = list_scores(item_keys(g, F.col("item_type"), F.col("subfields")), item_keys(p, F.col("item_type"), F.col("subfields")))
    return pairs.withColumn("score", F.when(F.col("category") == "list", lists).otherwise(scalar_scores(scalar)))


def needs_judge(pairs: DataFrame) -> DataFrame:
    """Free-text rows that neither null decides, so that a judge is asked for these only."""
    return pairs.where((F.col("category") == "free_text") & ~is_null(F.col("gold")) & ~is_null(F.col("predicted")))


def field_pairs(spec: DataFrame, gold: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each run, document and field of the spec, with gold and predicted values (missing: null).

    spec: doc_id, field, field_ix, type, item_type, tol_abs, tol_pct, subfields. gold: doc_id, field, value.
    runs: model, doc_id, field, value. The spec drives: extra fields of gold or runs are ignored.
    """
    docs = runs.select("model", "doc_id").distinct()
    rows = docs.join(spec, "doc_id").join(gold.withColumnRenamed("value", "g"), ["doc_id", "field"], "left").join(runs.withColumnRenamed("value", "p"), ["model", "doc_id", "field"], "left")
    return rows.select("model", "doc_id", "field", "field_ix", category_of(F.col("type")).alias("category"), "item_type", "subfields", "tol_abs", "tol_pct", value_of_variant(F.col("g")).alias("gold"), value_of_variant(F.col("p")).alias("predicted"))


def unknown_documents(spec: DataFrame, runs: DataFrame) -> DataFrame:
    return runs.select("doc_id").distinct().join(spec.select("doc_id").distinct(), "doc_id", "left_anti")


def document_scores(scored: DataFrame, by: tuple[str, ...] = ("model", "doc_id")) -> DataFrame:
    """Macro means over fields, rounded; columns precision, recall and f1 of each row."""
    means = [F.round(F.avg(c), DIGITS).alias(c) for c in ("precision", "recall", "f1")]
    return scored.groupBy(*by).agg(*means, F.count(F.lit(1)).alias("n_fields"), F.count_if("correct").alias("n_correct"))


def model_scores(documents: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Macro means over the rounded document scores, rounded again."""
    means = [F.round(F.avg(c), DIGITS).alias(c) for c in ("precision", "recall", "f1")]
    return documents.groupBy(*by).agg(*means, F.count(F.lit(1)).alias("n_documents"))


def gate(current: DataFrame, baseline: DataFrame, tolerance: float = GATE_TOLERANCE) -> DataFrame:
    """(model, pass, current_f1, baseline_f1, delta, note): the unrounded delta decides; no baseline passes with a note."""
    rows = current.select("model", F.col("f1").alias("current_f1")).join(baseline.select("model", F.col("f1").alias("baseline_f1")), "model", "left")
    delta = F.col("current_f1") - F.col("baseline_f1")
    return rows.select(
        "model", F.coalesce(delta >= -tolerance, F.lit(True)).alias("pass"), "current_f1", "baseline_f1", F.round(delta, DIGITS).alias("delta"),
        F.when(F.col("baseline_f1").isNull(), F.lit("no baseline")).alias("note"),
    )


def baseline_is_stale(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Models that the baseline lacks; any row means that a new snapshot is due."""
    return current.select("model").join(baseline.select("model"), "model", "left_anti")


def strictly_equal(a: Column, b: Column) -> Column:
    """Equal JSON texts, order of items included."""
    return F.coalesce(F.to_json(a) == F.to_json(b), a.isNull() & b.isNull())
