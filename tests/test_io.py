"""Sources, sinks and commands end to end, with injected transports."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from rankloom import cli
from rankloom.operators import extraction, retrieval, scoring
from rankloom.plans import pipelines
from rankloom.sources import readers, sinks

SPEC = {"documents": [{"doc_id": d, "fields": {"title": {"type": "string", "description": "t"}, "note": {"type": "free_text", "description": "n"}}} for d in ("d1", "d2")]}


@pytest.fixture
def golden(tmp_path):
    for doc, title in (("d1", "Alpha"), ("d2", "Beta")):
        (tmp_path / doc).mkdir()
        (tmp_path / doc / "source.md").write_text(f"# {title}\n## Design\n{title} trial design text.\n## Outcome\nRecovery time in days.\n## Arms\nPlacebo and treatment.\n")
        (tmp_path / doc / "retrieval.json").write_text(json.dumps([{"id": f"{doc}-1", "question": "recovery days", "expected_spans": [{"section": "Outcome", "quote": "Recovery time"}], "rationale": "r"}]))
        (tmp_path / doc / "golden.json").write_text(json.dumps({"title": title, "note": "heals fast"}))
    (tmp_path / "spec.json").write_text(json.dumps(SPEC))
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "system.txt").write_text("Give JSON.\n")
    return str(tmp_path)


def test_extract_stores_errors_and_tries_them_again(spark, golden):
    out = f"{golden}/out"
    args = ["--golden", golden, "--spec", f"{golden}/spec.json", "--out", out]
    parsed = cli.parser().parse_args([*args, "extract", "--model", "m", "--prompts", f"{golden}/prompts"])

    def flaky(system, user):
        return "no" if "Beta" in user else json.dumps({"title": "Alpha", "note": system})

    assert cli.extract(spark, parsed, flaky) == 0
    rows = sinks.load_runs(spark, out)
    assert [(r.doc_id, r.error_type) for r in rows.where("error IS NOT NULL").collect()] == [("d2", "BadAnswer")]
    assert rows.where("field = 'note'").select(F.try_variant_get("value", "$", "string")).first()[0] == "Give JSON."
    assert rows.where("created_at IS NULL").count() == 0

    def second(system, user):
        assert "Alpha" not in user  # it has been extracted
        return json.dumps({"title": "Beta", "note": "x"})

    assert cli.extract(spark, parsed, second) == 0
    rows = sinks.load_runs(spark, out)
    assert rows.where("error IS NOT NULL").count() == 0 and rows.select("doc_id").distinct().count() == 2
    assert cli.main([*args, "extract", "--model", "m"], spark) == 1  # no endpoint


def test_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache")
    chunks = spark.createDataFrame([("a",), ("b",), ("bad",)], "text string")
    none = spark.createDataFrame([], "model string, h string, v array<double>")

    def call(text):
        if text == "bad":
            raise extraction.ModelError("no")
        return [float(ord(text)), 0.0]

    with_v, new = extraction.embedded(chunks, none, call, "m")
    sinks.append_cache(new, path)
    assert with_v.count() == 2
    back = readers.embedding_cache(spark, f"{path}/*", "m")
    assert sorted(r.v for r in back.collect()) == [[97.0, 0.0], [98.0, 0.0]]
    assert [r.text for r in retrieval.cache_misses(chunks, back, model="m").collect()] == ["bad"]
    failed = extraction.embed(retrieval.cache_misses(chunks, back, model="m"), call, "m").first()
    assert failed.v is None and failed.error == "ModelError: no"


def test_baseline_round_trip(spark, tmp_path):
    path = str(tmp_path / "baseline")
    current = spark.createDataFrame([("m:1", 0.5, 0.25, 0.3333, 3)], "model string, precision double, recall double, f1 double, n_documents long")
    assert sinks.save_baseline(current, scoring.baseline_is_stale(current, readers.baseline(spark, path)), path)
    back = readers.baseline(spark, f"{path}/*.txt")
    assert [tuple(r) for r in back.collect()] == [("m:1", 0.5, 0.25, 0.3333, 3)]
    assert not sinks.save_baseline(current, scoring.baseline_is_stale(current, back), path)


def run_file(golden, name, extractions):
    (pytest.importorskip("pathlib").Path(golden) / name).write_text(json.dumps({"model": name, "created_at": "2026-01-01T00:00:00+00:00", "extractions": extractions}))


def test_judged_eval_and_missing_golden(spark, golden):
    run_file(golden, "m1.run", {"d1": {"title": "alpha", "note": "recovers quickly"}, "d2": {"title": "beta", "note": "Heals  fast"}})
    spec, gold, runs = readers.field_spec(spark, f"{golden}/spec.json"), readers.golden_records(spark, golden), readers.runs(spark, f"{golden}/*.run")
    plain = {(r.doc_id, r.field): r.correct for r in pipelines.run_eval(spec, gold, runs)[0].collect()}
    assert plain == {("d1", "title"): True, ("d1", "note"): False, ("d2", "title"): True, ("d2", "note"): True}
    judged = pipelines.run_judged_eval(spec, gold, runs, lambda system, user: json.dumps({"correct": "quickly" in user, "reason": "r"}), "judge")[0]
    assert {(r.doc_id, r.field): r.correct for r in judged.collect()} == {("d1", "title"): True, ("d1", "note"): True, ("d2", "title"): True, ("d2", "note"): False}
    with pytest.raises(FileNotFoundError, match="d2"):
        pipelines.run_eval(spec, gold.where("doc_id = 'd1'"), runs)


def test_eval_command_reports_models_without_runs(spark, golden, capsys):
    run_file(golden, "m1.run", {"d1": {"title": "alpha"}})
    args = ["--golden", golden, "--spec", f"{golden}/spec.json", "--runs", f"{golden}/*.run"]
    assert cli.main([*args, "eval", "--mock-run", "--model", "m1.run", "--model", "gone"], spark) == 0
    shown = capsys.readouterr().out
    assert "gone" in shown and "0.0000" in shown
    assert cli.main([*args, "eval", "--all-models"], spark) == 0 and "gone" not in capsys.readouterr().out


def test_retrieval_command_with_vectors(spark, golden, capsys):
    parsed = cli.parser().parse_args(["--golden", golden, "retrieval-eval", "--strategies", "bm25,dense,hybrid", "--cache", f"{golden}/cache", "--embed-model", "letters"])
    assert cli.retrieval_eval(spark, parsed, extraction.letter_embedder) == 0
    assert "hybrid" in capsys.readouterr().out

    def never(text):
        raise AssertionError("all texts are in the cache")

    assert cli.retrieval_eval(spark, parsed, never) == 0


def test_views(spark, golden):
    spec, gold, docs = readers.field_spec(spark, f"{golden}/spec.json"), readers.golden_records(spark, golden), readers.documents(spark, golden)
    scores, _ = pipelines.run_retrieval_eval(spark, golden, strategies=("bm25",))
    view = pipelines.document_view("d1", docs, spec, gold, scores, ("bm25",))
    assert [r.query_id for r in view["queries"].collect()] == ["d1-1"] and view["fields"].count() == 2
    run_file(golden, "m1.run", {"d1": {"title": "alpha"}})
    fields = pipelines.run_eval(spec, gold, readers.runs(spark, f"{golden}/*.run"))[0]
    assert pipelines.model_view("m1.run", fields).count() == 2


@pytest.mark.parametrize(("status", "error"), [(429, extraction.RateLimited), (503, extraction.RateLimited), (404, extraction.ModelError)])
def test_http_errors_are_mapped(monkeypatch, status, error):
    def fail(request, timeout):
        raise urllib.error.HTTPError("u", status, "x", {}, None)

    monkeypatch.setattr("urllib.request.urlopen", fail)
    for call in (lambda: extraction.http_embed("http://x", "m")("t"), lambda: extraction.http_chat("http://x", "m", "k")("s", "u"), lambda: extraction.list_models("http://x")):
        with pytest.raises(error):
            call()


def test_http_answers(monkeypatch):
    answers = iter([{"embeddings": [[1, 2]]}, {"embedding": [3]}, {"choices": [{"message": {"content": "c"}}]}, {"data": [{"id": "b"}, {"id": "a"}]}])
    monkeypatch.setattr("urllib.request.urlopen", lambda request, timeout: io.BytesIO(json.dumps(next(answers)).encode()))
    assert extraction.http_embed("http://x", "m")("t") == [1, 2] and extraction.http_embed("http://x", "m")("t") == [3]
    assert extraction.http_chat("http://x", "m", "k")("s", "u") == "c" and extraction.list_models("http://x") == ["a", "b"]


def test_model_is_loaded_once_a_worker():
    loads = []

    def load():
        loads.append(1)
        return lambda text: [float(len(text))]

    call = extraction.once_a_worker(load)
    assert [call("ab"), call("abc")] == [[2.0], [3.0]] and len(loads) == 1


def test_section_filter(spark):
    df = spark.createDataFrame([("c", 1, "Arms > Placebo", "apple"), ("c", 2, "Outcome", "apple")], "scope string, key long, section string, text string")
    q = spark.createDataFrame([("q", "apple"), ("r", "pear")], "query_id string, question string")
    extra = spark.createDataFrame([("c", n, "x", "other words") for n in range(3, 9)], df.schema)
    index = retrieval.bm25_index(df.unionByName(extra))
    assert [r.key for r in retrieval.search_bm25(index, q, 5, retrieval.in_section("PLACEBO")).collect()] == [1]


def test_dense_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(700, 6)).round(1), rng.normal(size=(5, 6)).round(1)
    x[5], x[6] = 0.0, x[7]
    rows = spark.createDataFrame([("s" if n % 2 else "t", n, x[n].tolist()) for n in range(len(x))], "scope string, key long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{n}", v.tolist(), "s") for n, v in enumerate(q)], "query_id string, vector array<double>, scope string")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(q) @ unit(x).T, 6)
    for k, asked in ((7, queries), (2000, queries), (7, queries.drop("scope"))):
        got = [(r.query_id, r.scope, r.key, r["rank"]) for r in retrieval.search_dense(rows, asked, k).collect()]
        want = []
        for n in range(len(q)):
            for scope, part in (("s", 1), ("t", 0)):
                if scope == "s" or "scope" not in asked.columns:
                    order = sorted((m for m in range(len(x)) if m % 2 == part), key=lambda m: (-scores[n, m], m))[:k]
                    want += [(f"q{n}", scope, m, r + 1) for r, m in enumerate(order)]
        assert sorted(got) == sorted(want)


def test_plans_have_no_product_and_scan_once(spark):
    from rankloom.plans import catalog

    d = "/root/testdata/sf0.001"
    plan = catalog.queries()["bm25_topk"](spark, d)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    plan = catalog.queries()["chunk_markdown_blocks"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
