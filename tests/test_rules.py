"""Rules over files and sets, resumable extraction, the judged evaluation and the choice of an embedder."""

import io
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rankloom import cli
from rankloom.operators import extraction, file_rules, validation
from rankloom.plans import pipelines
from rankloom.sources import readers, sinks
from rankloom.streaming import batch

KEY = "AKIA" + "B" * 16


@pytest.fixture
def tree(tmp_path):
    """A folder that breaks each rule once, and files that scans leave out."""
    files = {
        "README.md": b"hello\n",
        "docs/standards.md": b"rules",
        "pkg/good_name.py": b"x = 1\n",
        "pkg/__init__.py": b"",
        "pkg/BadName.py": b"y = 2\n",
        "pkg/with blank.txt": b"z",
        "tmp/left.txt": b"a",
        "pkg/things_old/a.txt": b"a",
        "pkg/run.log": b"a",
        "pkg/plan_old": b"a",
        ".env": b"SECRET",
        "data/ok.json": b'{"a": [1]}',
        "data/broken.json": b'{"a": ',
        "elsewhere/broken.json": b"{",
        "pkg/leak.txt": b"one\r\ntwo\r" + KEY.encode() + b"\nfour",
        "pkg/binary.bin": b"\0" + KEY.encode(),
        "pkg/late_zero.txt": b" " * 9000 + b"\0\n" + KEY.encode(),
        "pkg/bad_bytes.txt": b"\xff\xfe " + KEY.encode(),
        "pkg/large.txt": KEY.encode() + b" " * 3000,
        "node_modules/dep.txt": KEY.encode(),
        "out/report.txt": KEY.encode(),
    }
    for name, data in files.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "tree")


def failed(rows):
    return {(r.rule, r.entity, r.severity) for r in rows.where("NOT ok").collect()}


def test_committed_paths(spark, tree):
    paths = file_rules.walked(file_rules.listing(spark, tree))
    assert paths.where("path LIKE 'out/%' OR path LIKE 'node%'").count() == 0
    assert failed(file_rules.committed_rules(paths)) == {
        ("snake_case", "pkg/BadName.py", "error"), ("no_blank", "pkg/with blank.txt", "error"), ("no_forbidden_folder", "tmp/left.txt", "error"),
        ("no_forbidden_folder", "pkg/things_old/a.txt", "error"), ("no_forbidden_file", "pkg/run.log", "error"), ("no_forbidden_file", "pkg/plan_old", "error"), ("no_forbidden_file", ".env", "error"),
    }
    assert paths.where("path = 'pkg/large.txt'").first().size == 3020


def test_presence_and_siblings(spark, tree):
    assert failed(file_rules.presence(file_rules.listing(spark, tree))) == {("present", "docs/hld.md", "warning"), ("present", "docs/architecture.md", "warning")}
    names = spark.createDataFrame([("my-engine",), ("My_Engine",), ("other",)], "name string")
    assert failed(file_rules.sole(names, "my-engine", "^my[-_]*engine$")) == {("no_rogue_sibling", "My_Engine", "error")}


def test_secrets_in_files(spark, tree):
    texts = file_rules.contents(spark, tree, largest=9500)
    scanned = {r.path for r in texts.collect()}
    assert not {"pkg/binary.bin", ".env", "pkg/__init__.py", "node_modules/dep.txt", "out/report.txt"} & scanned
    assert {"pkg/leak.txt", "pkg/late_zero.txt", "pkg/large.txt", "pkg/bad_bytes.txt"} <= scanned
    assert {e for _, e, _ in failed(file_rules.secret_rules(texts))} == {"pkg/leak.txt:3", "pkg/late_zero.txt:2", "pkg/large.txt:1", "pkg/bad_bytes.txt:1"}
    small = file_rules.contents(spark, tree, largest=2000)
    assert "pkg/large.txt" not in {r.path for r in small.collect()}
    assert "GreaterThan(length,0), LessThanOrEqual(l" in small._jdf.queryExecution().executedPlan().toString()
    assert file_rules.contents(spark, tree + "-none").count() == 0


def test_json_files(spark, tree):
    assert failed(file_rules.json_rules(file_rules.contents(spark, tree))) == {("valid_json", "data/broken.json", "error")}
    summary = {r.rule: r for r in validation.summary(file_rules.folder_rules(spark, tree)).collect()}
    assert not summary["no_aws_access_key"].passed and summary["scanned_for_secrets"].passed and not summary["valid_json"].passed


def spec_rows(spark, spec, golden, **options):
    return file_rules.specification_rules(spark.createDataFrame([(spec if isinstance(spec, str) else json.dumps(spec),)], "text string"), spark.createDataFrame([(g,) for g in golden], "doc_id string"), **options)


def test_specification_as_a_set(spark):
    fields = {f: {"type": "string"} for f in file_rules.FIELD_DEFINITIONS}
    spec = {"documents": [{"doc_id": "a", "fields": fields}, {"doc_id": "b", "fields": {"nct_id": {}}}], "eval_config": {"extraction": {}}}
    assert failed(spec_rows(spark, spec, ["a", "b", "c"], documents=3)) == {
        ("document_count", "specification", "error"), ("specified", "c", "error"), ("field_definitions", "b", "warning"), ("has_retrieval_config", "specification", "warning"),
    }
    assert failed(spec_rows(spark, spec | {"eval_config": {"extraction": 1, "retrieval": 2}}, ["a"], documents=2)) == set()
    assert ("has_eval_config", "specification", "warning") in failed(spec_rows(spark, {"documents": []}, []))
    assert ("readable", "specification", "error") in failed(spec_rows(spark, "{", ["a"]))


# Golden data and commands

SPEC = {"documents": [{"doc_id": d, "fields": {"title": {"type": "string", "description": "t"}, "note": {"type": "free_text", "description": "n"}}} for d in ("d1", "d2", "d3")]}


@pytest.fixture
def golden(tmp_path):
    root = tmp_path / "golden"
    for doc in ("d1", "d2", "d3"):
        (root / doc).mkdir(parents=True)
        (root / doc / "source.md").write_text(f"# T {doc}\n## Design\n{doc} trial text.\n")
        (root / doc / "golden.json").write_text(json.dumps({"title": doc, "note": "heals fast"}))
        (root / doc / "retrieval.json").write_text(json.dumps([{"id": f"{doc}-1", "question": "trial", "expected_spans": [{"section": "Design", "quote": "trial text"}], "rationale": "r"}]))
    (tmp_path / "spec.json").write_text(json.dumps(SPEC))
    (tmp_path / "runs").mkdir()
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "judge.txt").write_text("Judge strictly.")
    return tmp_path


def args(golden, *more):
    return cli.parser().parse_args(["--golden", f"{golden}/golden", "--spec", f"{golden}/spec.json", "--runs", f"{golden}/runs/*.json", "--baseline", f"{golden}/baseline", "--out", f"{golden}/out", *more])


def asker(golden, fail=()):
    """A transport that notes each call in a file, as calls are made by other processes."""
    log = golden / "calls"

    def ask(system, user):
        doc = next(d for d in ("d1", "d2", "d3") if f"{d} trial" in user)
        with open(log, "a") as f:
            f.write(f"{doc}\n")
        if doc in fail:
            raise extraction.ModelError("no")
        return json.dumps({"title": doc, "note": "n"})

    return ask, lambda: sorted(log.read_text().split()) if log.exists() else []


def test_stopped_run_goes_on_and_asks_no_document_twice(spark, golden, monkeypatch):
    ask, calls = asker(golden)
    save, saves = sinks.save_runs, []

    def stop_after_two(rows, path):
        save(rows, path)
        saves.append(1)
        if len(saves) == 2:
            raise RuntimeError("stopped")  # after the second batch was saved, before it is committed

    monkeypatch.setattr(sinks, "save_runs", stop_after_two)
    spec = readers.field_spec(spark, f"{golden}/spec.json")
    run = lambda: batch.extract_all(spark, f"{golden}/golden", spec, ask, "m:1", f"{golden}/out", limits=batch.Limits(batch=1, lanes=2))
    with pytest.raises(Exception, match="stopped"):
        run()
    assert len(calls()) == 2
    at = batch.attempt_of(spark, f"{golden}/out", "m:1")
    monkeypatch.setattr(sinks, "save_runs", save)
    assert (run().asked, calls()) == (1, ["d1", "d2", "d3"])
    assert batch.attempt_of(spark, f"{golden}/out", "m:1") != at
    assert run().asked == 0 and len(calls()) == 3
    assert sinks.load_runs(spark, f"{golden}/out").select("doc_id").distinct().count() == 3


def test_failed_calls_are_asked_again_by_the_next_run(spark, golden, capsys):
    ask, calls = asker(golden, ("d1", "d2", "d3"))
    assert cli.extract(spark, args(golden, "extract", "--model", "m"), ask) == 1  # all failed
    assert "0 of 3" in capsys.readouterr().out
    ask, calls = asker(golden, ("d2",))
    assert cli.extract(spark, args(golden, "extract", "--model", "m", "--doc", "d1", "--doc", "d2"), ask) == 0
    assert "1 of 2" in capsys.readouterr().out
    ask, calls = asker(golden)
    assert cli.extract(spark, args(golden, "extract", "--model", "m"), ask) == 0
    assert calls() == ["d1", "d1", "d2", "d2", "d2", "d3", "d3"]
    assert sinks.load_runs(spark, f"{golden}/out").where("error IS NOT NULL").count() == 0


def test_documents_without_a_specification_raise_before_any_call(spark, golden):
    (golden / "golden" / "d9").mkdir()
    (golden / "golden" / "d9" / "source.md").write_text("d9 trial")
    ask, calls = asker(golden)
    with pytest.raises(KeyError, match="d9"):
        cli.extract(spark, args(golden, "extract", "--model", "m"), ask)
    docs, spec = readers.documents(spark, f"{golden}/golden"), readers.field_spec(spark, f"{golden}/spec.json")
    with pytest.raises(KeyError, match="d9"):
        extraction.extract(docs, spec, ask, "m")
    assert calls() == []


def test_rate_is_shared_by_lanes():
    assert batch.Limits(lanes=8, rate=4.0).pause_s == 2.0 and batch.Limits().pause_s == 0.0


def run_file(golden, name, extractions):
    (golden / "runs" / f"{name}.json").write_text(json.dumps({"model": name, "created_at": "2026-01-01T00:00:00", "extractions": extractions}))


def test_judged_eval_replaces_the_baseline_and_asks_the_one_before(spark, golden, capsys):
    run_file(golden, "m1", {d: {"title": d, "note": "fast healing"} for d in ("d1", "d2", "d3")})
    (golden / "runs" / "broken.json").write_text("{")
    (golden / "runs" / "nameless.json").write_text("{}")

    def ask(system, user):
        assert system == "Judge strictly."
        return json.dumps({"correct": json.loads(user)["candidate"] == "fast healing", "reason": "r"})

    command = ("judged-eval", "--judge-model", "j", "--prompts", f"{golden}/prompts")
    assert cli.judged_eval(spark, args(golden, *command), ask) == 0
    shown = capsys.readouterr()
    assert "1.0000" in shown.out and "baseline written" in shown.out and "2 of 3 run files skipped" in shown.err
    assert [(r.model, r.f1) for r in readers.baseline(spark, f"{golden}/baseline").collect()] == [("m1", 1.0)]
    run_file(golden, "m2", {"d1": {"title": "x", "note": "slow"}})
    assert cli.judged_eval(spark, args(golden, *command, "--model", "m1", "--model", "m2", "--model", "gone"), ask) == 0
    assert "no baseline" in capsys.readouterr().out  # of m2, in the gate
    assert {r.model for r in readers.baseline(spark, f"{golden}/baseline").collect()} == {"m1", "m2", "gone"}
    assert cli.judged_eval(spark, args(golden, *command)) == 1  # no endpoint


def test_skipped_files_are_counted(spark, golden):
    run_file(golden, "m1", {"d1": {"title": "x"}})
    (golden / "runs" / "broken.json").write_text("[")
    seen, values = Observation("runs"), Observation("values")
    assert readers.runs(spark, f"{golden}/runs/*.json", seen).count() == 1
    assert seen.get == {"files": 2, "skipped": 1}
    rows = {r.name: r.ok for r in readers.artifact_values(spark, f"{golden}/runs/*.json", values).select("name", F.col("value").isNotNull().alias("ok")).collect()}
    assert rows == {"m1.json": True, "broken.json": False} and values.get == {"files": 2, "skipped": 1}
    assert readers.artifact_names(spark, f"{golden}/runs/*") == ["broken.json", "m1.json"]
    assert readers.artifact_names(spark, f"{golden}/nothing/*") == [] and readers.artifact_values(spark, f"{golden}/nothing/*").count() == 0


def test_validate_command(spark, golden, tree, capsys):
    assert cli.validate(spark, args(golden, "validate", "--documents", "3", "--files", tree)) == 1
    shown = capsys.readouterr().out
    assert "document_count" in shown and "query_count" in shown and "pkg/leak.txt:3" in shown
    rows = pipelines.golden_checks(spark, f"{golden}/golden", f"{golden}/spec.json", 4)
    bad = failed(rows)
    assert ("document_count", "specification", "error") in bad and ("source_size", "d1", "warning") in bad and ("nct_id", "d2", "error") in bad
    assert ("span_count", "d1", "warning") in bad and not any(rule == "specified" for rule, _, _ in bad)


def test_scorecard_page(spark, golden):
    run_file(golden, "m1", {d: {"title": d, "note": "heals fast"} for d in ("d1", "d2", "d3")})
    run_file(golden, "m2", {"d1": {"title": "d1"}, "d2": {"title": "no"}})
    spec, gold = readers.field_spec(spark, f"{golden}/spec.json"), readers.golden_records(spark, f"{golden}/golden")
    fields, docs, models = pipelines.run_eval(spec, gold, readers.runs(spark, f"{golden}/runs/*.json"))
    _, report = pipelines.run_retrieval_eval(spark, f"{golden}/golden", strategies=("bm25",))
    page = {k: v.collect() for k, v in pipelines.scorecard(fields, docs, models, report).items()}
    assert [(r.model, r.band) for r in page["models"]] == [("m1", "high"), ("m2", "low")]
    assert [(r.doc_id, r.best_model, r.n_models, r.n_fields) for r in page["documents"]] == [("d1", "m1", 2, 2), ("d2", "m1", 2, 2), ("d3", "m1", 1, 2)]
    assert len(page["retrieval"]) == 1 and len(page["retrieval_by_document"]) == 3 and page["correct"][0].n_correct == 2


# Embedders


def test_embedder_is_probed_and_chosen(golden, monkeypatch):
    offered = {"models": [{"name": "e:1"}]}
    monkeypatch.setattr("urllib.request.urlopen", lambda request, timeout: io.BytesIO(json.dumps(offered if request.full_url.endswith("/api/tags") else {"embedding": [1.0]}).encode()))
    choice = lambda *more: cli.embedder(args(golden, "retrieval-eval", *more))
    model, call = choice("--embed-server", "http://x/", "--embed-model", "e:1")
    assert model == "e:1" and call("t") == [1.0]
    assert choice("--embed-server", "http://x/", "--embed-model", "e:2") is None  # not listed, and no local library
    assert choice("--embedder", "none", "--embed-url", "http://x") is None
    assert choice("--embed-url", "http://x", "--embed-server", "http://y")[0] == "embedding"

    def down(request, timeout):
        raise OSError("refused")

    monkeypatch.setattr("urllib.request.urlopen", down)
    assert choice("--embed-server", "http://x/", "--embed-model", "e:1") is None
    with pytest.raises(ZeroDivisionError):  # an error of the program's own isn't hidden
        extraction.pick_embedder([("x", lambda: 1 / 0)])


def test_models_do_not_share_vectors_by_command(spark, golden, capsys):
    def run(model, call):
        return cli.retrieval_eval(spark, args(golden, "retrieval-eval", "--strategies", "dense", "--cache", f"{golden}/vectors", "--embed-model", model), call)

    log = golden / "embedded"

    def noted(text):
        with open(log, "a") as f:
            f.write("x")
        return extraction.letter_embedder(text)

    assert run("a", noted) == 0
    n = len(log.read_text())
    assert n > 0 and run("a", noted) == 0 and len(log.read_text()) == n
    assert run("b", noted) == 0 and len(log.read_text()) == 2 * n
