"""The stored BM25 index and tiled dense search: brute force, plans, and what is read."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import postings, retrieval, vectors
from rankloom.plans import catalog
from rankloom.sources import readers  # noqa: F401

SF = "/root/testdata/sf0.001"


def corpus(spark, n, scopes=2, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    rows = [(f"s{i % scopes}", i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 30))), rng.choice("xy")) for i in range(n)]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(12)]
    return spark.createDataFrame(rows, "scope string, key long, text string, kind string"), spark.createDataFrame(asked, "query_id string, question string")


def ranked(df):
    return sorted((r.query_id, r.scope, r["rank"], r.key, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 4, 50])
@pytest.mark.parametrize("block", [2, 16])
def test_skipping_blocks_changes_nothing(spark, monkeypatch, k, block):
    docs, asked = corpus(spark, 300)
    monkeypatch.setattr(postings, "BLOCK_CHUNKS", block)
    monkeypatch.setattr(postings, "FEW_POSTINGS", 0)
    index = retrieval.bm25_index(docs)
    assert index.largest > postings.FIRST * block
    for where in (None, F.col("kind") == "x"):
        every = postings.Search(index, asked).scores().where("score > 0")
        if where is not None:
            every = every.join(docs.where(where).select("scope", "key"), ["scope", "key"], "left_semi")
        assert ranked(retrieval.search_bm25(index, asked, k, where)) == ranked(retrieval.top(every, k))
        assert ranked(retrieval.top(postings.Search(index, asked).every(where), k)) == ranked(retrieval.top(every, k))


def test_bounds_hold_and_skip(spark, monkeypatch):
    docs, asked = corpus(spark, 400, 1, 3)
    monkeypatch.setattr(postings, "BLOCK_CHUNKS", 4)
    index = retrieval.bm25_index(docs)
    search = postings.Search(index, asked)
    block = F.pmod(F.xxhash64("key"), F.lit(100)).alias("block")
    best = search.scores().select("query_id", "scope", block, "score").groupBy("query_id", "scope", "block").agg(F.max("score").alias("best"))
    both = search.bounds().join(best, ["query_id", "scope", "block"])
    assert both.count() > 500 and both.where("best > bound + 1e-6").count() == 0
    assert search.best(1).count() < search.scores().where("score > 0").count() / 4


def test_a_common_term_is_in_rows_of_bounded_size(spark):
    docs = spark.createDataFrame([("s", i, "the same words") for i in range(2000)], "scope string, key long, text string")
    sizes = retrieval.bm25_index(docs).blocks.where("term = 'the'").select("n").collect()
    assert sum(r.n for r in sizes) == 2000 and max(r.n for r in sizes) < 3 * postings.BLOCK_CHUNKS


def test_index_is_opened_again_and_serves_several_buckets(spark, monkeypatch, tmp_path):
    docs, asked = corpus(spark, 120)
    whole = ranked(retrieval.search_bm25(retrieval.bm25_index(docs), asked, 5))
    monkeypatch.setattr(postings, "BUCKET_CHUNKS", 40)
    retrieval.bm25_index(docs, path=str(tmp_path / "i"))
    again = postings.opened(docs, str(tmp_path / "i"))
    assert again.blocks.select("bucket").distinct().count() == 3
    assert ranked(retrieval.search_bm25(again, asked, 5)) == whole


def test_index_of_nothing_and_of_null_texts(spark):
    none = spark.createDataFrame([], "scope string, key long, text string")
    asked = spark.createDataFrame([("q", "a b")], "query_id string, question string")
    assert retrieval.search_bm25(retrieval.bm25_index(none), asked, 3).count() == 0
    docs = spark.createDataFrame([("s", 1, None), ("s", 2, ""), ("s", 3, "a"), ("s", 4, "c"), (None, 5, "a")], none.schema)
    index = retrieval.bm25_index(docs)
    assert index.stats.collect()[0][:2] == ("s", 4)
    assert [r.key for r in retrieval.search_bm25(index, asked, 3).collect()] == [3]
    assert sorted((r.key, r.dl) for r in index.lengths.collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def scans_of_text(df):
    """Scans of document texts in a physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet \[[^\]]*\btext#[^\]]*\][^\n]*documents", plan))


def test_texts_are_read_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.lit("all").alias("scope"), F.col("doc_id").alias("key"), "text")
    counts = docs.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    assert scans_of_text(counts) == 0
    assert scans_of_text(postings.postings_of(docs, 1, counts, 1)) == 1
    queries = catalog.queries()
    for name, most in (("bm25_topk", 0), ("bm25_filtered_lang", 0), ("bm25_topk_per_source", 0), ("term_df", 0), ("retrieval_grouping_sets", 1)):
        assert scans_of_text(queries[name](spark, SF)) <= most, name


def brute(x, q, scopes, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = vectors.rounded(unit(q) @ unit(x).T)
    out = []
    for n in range(len(q)):
        for scope in ("s", "t"):
            if scopes is None or scopes[n] == scope:
                order = sorted((m for m in range(len(x)) if ("s" if m % 2 else "t") == scope), key=lambda m: (-scores[n, m], m))[:k]
                out += [(f"q{n}", scope, r + 1, m) for r, m in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("k", [3, 2000])
@pytest.mark.parametrize("scoped", [True, False])
def test_tiles_against_brute_force(spark, monkeypatch, k, scoped):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    monkeypatch.setattr(vectors, "TILE_BYTES", 600)
    monkeypatch.setattr(vectors, "PART_BYTES", 6000)
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 6)).round(1), rng.normal(size=(23, 6)).round(1)
    x[5] = 0.0
    x[9] = x[7]
    scopes = ["s" if n % 3 else "t" for n in range(len(q))]
    rows = spark.createDataFrame([("s" if n % 2 else "t", n, x[n].tolist()) for n in range(len(x))] + [(None, 999, [1.0] * 6)], "scope string, key long, vector array<double>")
    asked = spark.createDataFrame([(f"q{n}", q[n].tolist(), scopes[n]) for n in range(len(q))], "query_id string, vector array<double>, scope string")
    found = retrieval.search_dense(rows, asked if scoped else asked.drop("scope"), k)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Cogroup" in plan.replace("CoGroup", "Cogroup")
    assert sorted((r.query_id, r.scope, r["rank"], r.key) for r in found.collect()) == brute(x, q, scopes if scoped else None, k)


def test_tiles_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    rows = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, None), ("s", 3, [1.0]), ("s", 4, [None, 1.0])], "scope string, key long, vector array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, None])], "query_id string, vector array<double>")
    tiles = sorted(map(tuple, retrieval.search_dense(rows, asked, 2).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 1 << 20)
    assert tiles == sorted(map(tuple, retrieval.search_dense(rows, asked, 2).collect()))
