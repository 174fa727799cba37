"""The table of vectors: models apart, the last vector holds, no shuffle of the table, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import text_hash
from rankloom.operators import extraction
from rankloom.sources import readers, sinks
from rankloom.sources.vector_cache import VectorCache


@pytest.fixture
def cache(spark, tmp_path):
    return VectorCache(spark, str(tmp_path / "cache"), buckets=4)


def rows(spark, model, **vectors):
    return spark.createDataFrame([(model, t, v) for t, v in vectors.items()], "model string, text string, v array<double>").select("model", text_hash("text").alias("h"), "v")


def texts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "text string")


def held(spark, cache, model, *names):
    return {r.text: r.v for r in cache.with_vectors(texts(spark, *names), model).collect()}


def test_models_share_a_folder_without_mixing(spark, cache, tmp_path):
    assert held(spark, cache, "m:1", "a") == {}
    cache.append(rows(spark, "m:1", a=[1.0], b=[2.0]), "m:1")
    cache.append(rows(spark, "m/1", a=[9.0]), "m/1")
    again = VectorCache(spark, str(tmp_path / "cache"), buckets=4)
    assert held(spark, again, "m:1", "a", "b", "c") == {"a": [1.0], "b": [2.0]}
    assert held(spark, again, "m/1", "a", "b") == {"a": [9.0]}
    assert [r.text for r in again.misses(texts(spark, "a", "b", "b", "c", None), "m/1").orderBy("text").collect()] == ["b", "c"]
    assert again.misses(texts(spark, "a", "b"), "other").count() == 2


def test_the_last_vector_holds_and_nulls_are_not_stored(spark, cache):
    cache.append(rows(spark, "m", a=[1.0], b=None), "m")
    cache.append(rows(spark, "m", a=[2.0]), "m")
    assert held(spark, cache, "m", "a", "b") == {"a": [2.0]}


def test_compaction(spark, cache):
    cache.append(rows(spark, "other:x", a=[7.0]), "other:x")
    for n in range(4):
        cache.append(rows(spark, "m:1", **{f"t{k}": [float(n)] for k in range(20)}), "m:1")

    def files():
        return sum(f.endswith(".parquet") for _, _, names in os.walk(cache.path) for f in names)

    before = files()
    cache.compact("m:1")
    assert files() <= 5 < before
    assert cache.rows("m:1").count() == 20
    assert held(spark, cache, "m:1", "t0", "t19") == {"t0": [3.0], "t19": [3.0]}
    assert held(spark, cache, "other:x", "a") == {"a": [7.0]}
    cache.append(rows(spark, "m:1", t0=[8.0]), "m:1")
    assert held(spark, cache, "m:1", "t0") == {"t0": [8.0]}
    cache.compact("nobody")


def test_joins_do_not_shuffle_the_table(spark, cache):
    cache.append(rows(spark, "m", **{f"t{k}": [float(k)] for k in range(50)}), "m")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (cache.with_vectors(texts(spark, "t1"), "m"), cache.misses(texts(spark, "t1"), "m")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scans = [line for line in plan.splitlines() if "FileScan" in line]
            assert len(scans) == 1 and "Bucketed: true" in scans[0]
            depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
            lines = plan.splitlines()
            at = lines.index(scans[0])
            above, least = [], depth(scans[0])
            for line in reversed(lines[:at]):  # the scan's ancestors
                if depth(line) < least:
                    above.append(line)
                    least = depth(line)
            assert not any("Exchange" in line for line in above), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_json_lines_keep_their_model(spark, tmp_path):
    path = str(tmp_path / "lines")
    for model, value in (("m1", 1.0), ("m2", 2.0)):
        new = extraction.embed(texts(spark, "a").select(text_hash("text").alias("h"), "text"), lambda text, v=value: [v], model)
        sinks.append_cache(new, path)
    for model, value in (("m1", [1.0]), ("m2", [2.0])):
        assert [r.v for r in readers.embedding_cache(spark, f"{path}/*", model).collect()] == [value]
    assert readers.embedding_cache(spark, f"{path}/*", "m3").count() == 0


def test_cache_lines_are_counted(spark, tmp_path):
    from pyspark.sql import Observation

    (tmp_path / "c.jsonl").write_text('{"h": "a", "v": [1, 2]}\nnot json\n{"h": "b"}\n\n{"h": "a", "v": [3]}\n{"model": "x", "h": "q", "v": [1]}\n')
    seen = Observation("lines")
    assert readers.embedding_cache(spark, str(tmp_path / "c.jsonl"), "m", seen).count() == 1
    assert seen.get == {"lines": 5, "skipped": 2}  # an empty line is none
