"""BM25 where texts lie: the same results as those of the stored index, without a shuffle of texts or pairs."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import lowered, tokens
from rankloom.operators import postings, retrieval, scan
from rankloom.operators.arrow import words
from rankloom.plans import retrieval_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("source").alias("scope"), F.col("doc_id").alias("key"), "text", "lang")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def ranked(df):
    return sorted((r.query_id, r.scope, r.rank, r.key, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize("cells", [1, 1000, 2_000_000])
def test_scan_gives_what_the_index_gives(spark, docs, asked, monkeypatch, cells):
    monkeypatch.setattr(scan, "CELLS", cells)
    index, corpus = retrieval.bm25_index(docs), scan.counted(docs)
    where, scoped = F.col("lang") == "de", asked.withColumn("scope", F.concat(F.lit("src"), (F.col("query_id") % 4).cast("string")))
    for q, k, w in ((asked, 3, None), (asked, 5, where), (scoped, 2, None)):
        want = ranked(retrieval.search_bm25(index, q, k, w))
        assert want and ranked(retrieval.search_bm25(corpus, q, k, w)) == want


def test_more_queries_than_a_task_takes_go_to_the_index(spark, docs, asked, monkeypatch):
    corpus = scan.counted(docs)
    want = ranked(retrieval.search_bm25(corpus, asked, 3))
    monkeypatch.setattr(scan, "MAX_WORDS", 5)
    assert ranked(retrieval.search_bm25(corpus, asked, 3)) == want and "index" in corpus.__dict__


def test_scan_of_odd_texts(spark):
    rows = [("s", "b", "red blue red"), ("s", "a", "red blue red"), ("s", "c", None), ("s", "d", ""), (None, "e", "red"), ("t", "f", "green"), ("s", "g", "x"), ("s", "h", "y")]
    corpus = scan.counted(spark.createDataFrame(rows, "scope string, key string, text string"))
    q = spark.createDataFrame([(1, "red"), (2, None), (3, "none")], "query_id long, question string")
    assert [(r.query_id, r.scope, r.key, r.rank) for r in retrieval.search_bm25(corpus, q, 1).collect()] == [(1, "s", "a", 1)]
    assert {(r.scope, r.n, r.longest) for r in corpus.stats.collect()} == {("s", 6, 3), ("t", 1, 1)}
    empty = scan.counted(spark.createDataFrame([], "scope string, key string, text string"))
    assert retrieval.search_bm25(empty, q, 1).count() == 0 and retrieval.search_bm25(corpus, q.where("false"), 1).count() == 0


def test_no_text_and_no_pair_is_shuffled(spark, docs, asked):
    plan = scan.best(scan.counted(docs), asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_queries_scan(spark, monkeypatch):
    """No query of plans/ builds the stored index."""
    monkeypatch.setattr(postings, "build", None)
    for name in ("rrf_fusion", "bm25_topk_per_source", "doc_len_stats", "bm25_idf", "first_match_rank"):
        assert retrieval_queries.R.queries[name](spark, SF).count() > 0


def test_cosine_pairs_hands_on_a_row_a_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "search_dense", None)
    rows = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 2.0]), ("a", 3, None), ("a", 4, [3.0, 3.0])], "scope string, key long, vector array<double>").repartition(3)
    q = rows.where("key IN (1, 4)").select(F.col("key").alias("query_id"), "vector")
    got = {r.query_id: (r.n, round(r.mean, 4), r.best) for r in retrieval.cosine_summary(rows, q).collect()}
    assert got == {1: (4, 0.4268, 0.707107), 4: (4, 0.6036, 0.707107)}


def test_chunks_hold_a_slice_of_a_batch(spark, monkeypatch):
    from rankloom.operators import chunking

    df = spark.createDataFrame([(n, None if n == 3 else f"# T\n## A\nx{n}\n## B\ny") for n in range(200)], "doc_id long, text string")
    got = sorted((r.chunk_id, r.text) for r in chunking.chunks(df).collect())
    assert got == sorted((f"{n}-{s}-{i}", t) for n in range(200) if n != 3 for s, i, t in (("a", 1, f"x{n}"), ("b", 2, "y")))
    plan = chunking.chunks(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "Exchange" not in plan


def test_doc_len_stats_stores_no_words(spark, tmp_path, monkeypatch):
    """Lengths take one pass, and documents without a language have a row, as in SQL."""
    rows = [(1, "a b-c", "en", "s", 5), (2, "a", "en", "s", 1), (3, None, "de", "s", 0), (4, "x y", None, "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scan, "counted", None)
    got = {r.scope: (r.n, r.avgdl, r.longest) for r in retrieval_queries.doc_len_stats(spark, str(tmp_path)).collect()}
    assert got == {"en": (2, 2.0, 3), "de": (1, 0.0, 0), None: (1, 2.0, 2)}


def test_strategy_pivot_reads_ranked_texts_once(spark, monkeypatch):
    found, calls = retrieval_queries._found, []
    monkeypatch.setattr(retrieval_queries, "_found", lambda *a: calls.append(a) or found(*a))
    rows = retrieval_queries.strategy_pivot(spark, SF).collect()
    assert len(calls) == 1 and len(rows) == spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert all(r.dense_hit is not None and r.bm25_mrr is not None for r in rows)


@pytest.mark.parametrize("name", ["enrich_queries", "first_match_rank", "hit_recall_mrr_bm25"])
def test_bm25_scores_ask_for_no_vectors(spark, monkeypatch, name):
    """Queries that rank by BM25 alone plan no dense ranking beside it."""
    monkeypatch.setattr(retrieval, "search_dense", None)
    assert retrieval_queries.R.queries[name](spark, SF).count() > 0


def test_letters_are_counted(spark):
    row = spark.sql("SELECT 'Zaß aÄAİ z' AS t, CAST(NULL AS STRING) AS n").select(retrieval_queries._letters(F.col("t")).alias("v"), retrieval_queries._letters(F.col("n")).alias("w")).first()
    assert {c: n for c, n in zip("abcdefghijklmnopqrstuvwxyz", row.v) if n} == {"a": 3.0, "i": 1.0, "z": 2.0} and row.w == [0.0] * 26


@pytest.mark.parametrize("name", ["score_bands", "bm25_in_section", "bm25_topk_per_source", "bm25_idf", "retrieval_grouping_sets", "bm25_filtered_lang", "hit_recall_mrr_hybrid", "first_match_rank", "bm25_topk", "matched_ranks", "hit_recall_mrr_bm25"])
def test_queries_build_no_index(spark, monkeypatch, name):
    """Words are counted and texts scored where they lie: there are no stored postings, and no pairs of them."""
    monkeypatch.setattr(postings, "build", None)
    monkeypatch.setattr(postings, "Search", None)
    assert retrieval_queries.R.queries[name](spark, SF).count() > 0


def test_words_are_those_of_tokens(spark):
    """Texts are cut into words by bytes in tasks, as tokens() cuts them in the JVM."""
    cuts = "\t\n\x0b\x0c\r -\x85\xa0        　"
    near = ["\x1c", "\x1f", "\x08", "\x0e", "᠎", "​", "‐", "⁠", "﻿", "İß", "ÄÉ", "日本", "\U0001f600", ".", "A"]
    texts = [None, "", " ", "-", *[f"{c}Aa{c}{c}b{c}" for c in cuts], *[f"x{c}y z" for c in near], "", "a", "b", "".join(x + y for x in near for y in cuts), "Ends-here", "x"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, t string").coalesce(1).sortWithinPartitions("n")
    got = df.select("n", lowered("t").alias("low"), tokens("t").alias("want")).toArrow()
    for part in (got, got.slice(3, 20), got.slice(2, 1), got.slice(0, 0)):
        low = part["low"].combine_chunks() if len(part) else pa.array([], pa.string())
        row, found = words(low)
        want = [(n, w) for n, ws in enumerate(part["want"].to_pylist()) for w in ws]
        assert list(zip(row.tolist(), found.to_pylist(), strict=True)) == want
    found.validate(full=True)


def test_scan_cuts_words_in_tasks(spark, docs, asked):
    """No regular expression of the JVM cuts texts, neither for counts nor for scores."""
    corpus = scan.counted(docs)
    plan = scan.best(corpus, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "lower(" in plan


def test_letters_are_counted_in_tasks(spark):
    """A text's letters are counted in one pass over its bytes, not by a replacement a letter; rows keep their order in slices."""
    rows = [(n, t) for n, t in enumerate([None, "", "abcz", "B-é b", "", "zz" * 500, "日本a"])]
    df = spark.createDataFrame(rows, "n long, t string").select("n", retrieval_queries._letters(F.col("t")).alias("v"))
    assert "replace(" not in df._jdf.queryExecution().executedPlan().toString().lower()
    assert {r.n: r.v for r in df.collect()} == {n: [float((t or "").lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for n, t in rows}
