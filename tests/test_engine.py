"""Operators of the engine on small cases, against loops where SQL can't express them."""

import json
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import chunking, evaluation, extraction, retrieval, scoring, validation
from rankloom.plans import pipelines
from rankloom.sources import readers, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


# text


@pytest.mark.parametrize(("x", "want"), [("Day-29 Mortality.", ["day", "29", "mortality."]), ("  ", []), (None, []), ("a b a", ["a", "b", "a"])])
def test_tokens(spark, x, want):
    assert one(spark, x, T.tokens) == want


@pytest.mark.parametrize(("x", "want"), [("1,062", 1062.0), (" 3.5e1 ", 35.0), ("12d", None), ("", None), ("1_000", None), ("-.5", -0.5), (None, None)])
def test_number(spark, x, want):
    assert one(spark, x, T.number) == want


@pytest.mark.parametrize(("x", "want"), [("2020-02-21T00", ("2020", "02", "21")), ("20200221", ("2020", None, None)), ("2020-2", ("2020", "2", None)), ("x", None)])
def test_partial_date(spark, x, want):
    got = one(spark, x, T.partial_date)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("x", "want"), [("Study Design!", "study-design"), ("--", "root"), ("A > B", "a-b")])
def test_slug(spark, x, want):
    assert one(spark, x, T.slug) == want


@pytest.mark.parametrize(("x", "error"), [('```json\n{"a": 1}\n```', None), ('{"a": 1}', None), ("[1]", "expected a JSON object"), ("no", "invalid JSON"), ('{"a":1} x', "invalid JSON"), (None, "invalid JSON")])
def test_parsed_object(spark, x, error):
    assert one(spark, x, lambda c: T.parsed_object(c)["error"]) == error


def test_section_and_text_match(spark):
    rows = [("Eligibility Criteria > Full Criteria", "eligibility criteria", True), ("Arms > Placebo", "X > placebo", True), ("Arms", "Outcomes", False), ("Arms", "", True)]
    df = spark.createDataFrame(rows, "s string, e string, want boolean")
    assert df.where(T.section_matches(F.col("s"), F.col("e")) != F.col("want")).count() == 0


# chunking


HEADERS = [
    ("intro\n# Title\nmore\n## A\nbody a\n### B\nbody b\n#### C\nc\n## D\n\n### E\ne", [(0, "Document", "intro\nmore"), (1, "A", "body a"), (2, "A > B", "body b"), (3, "A > C", "c"), (5, "D > E", "e")]),
    ("### first\nx\n### second\ny\n# mid\nz", [(1, "first", "x"), (2, "first > second", "y\nz")]),
    ("no header at all", [(0, "Document", "no header at all")]),
    ("", []),
    ("## A\n## B\n\n##no blank\n####### seven\n", [(2, "B", "##no blank\n####### seven")]),
    ("### x\na\n## y\nb\n### z\nc", [(1, "x", "a"), (2, "y", "b"), (3, "y > z", "c")]),
    ("\u00a0lead\n##\u00a0 Caf\u00e9 \u2265 \nbody \u00a0\n", [(0, "Document", "lead"), (1, "Caf\u00e9 \u2265", "body")]),
]


def test_header_blocks(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADERS)] + [(99, None)], "doc_id long, text string")
    got = {}
    for r in chunking.header_blocks(df).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append((r.block, r.section, r.body))
    assert got == {i: want for i, (_, want) in enumerate(HEADERS) if want}


def test_rows_that_share_an_id_are_cut_apart(spark):
    df = spark.createDataFrame([(1, "## A\nx"), (1, "## B\ny\n### C\nz")], "doc_id long, text string")
    assert sorted((r.section, r.text, r.chunk_ix) for r in chunking.chunks(df).collect()) == [("A", "x", 1), ("B", "y", 1), ("B > C", "z", 2)]


PACKED = [
    ("short", 12, 3, ["short"]),
    ("aa\n\nbbbb\n\ncc", 10, 2, ["aa\n\nbbbb", "cc"]),
    ("aaaa\n\nbbbb", 8, 0, ["aaaa", "bbbb"]),
    ("x" * 25, 10, 2, ["x" * 10, "x" * 10, "x" * 9]),
    ("0123456789abcdef", 10, 4, ["0123456789", "6789abcdef"]),
    ("a\n \t\n0123456789abcdef\n\nz", 12, 4, ["a", "0123456789ab", "89abcdef\n\nz"]),
    ("a\n\n\n\nb" + "c" * 12, 12, 0, ["a", "b" + "c" * 11, "c"]),
    ("\u00e9\U0001f600" * 6 + "!", 12, 0, ["\u00e9\U0001f600" * 6, "!"]),
]


@pytest.mark.parametrize(("body", "most", "overlap", "want"), PACKED)
def test_pieces(spark, body, most, overlap, want):
    assert one(spark, body, lambda c: chunking.pieces(c, most, overlap)) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(bodies=st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=8), min_size=1, max_size=20), most=st.integers(8, 40), overlap=st.integers(0, 7))
def test_properties_of_pieces(spark, bodies, most, overlap):
    """Pieces are bounded, hold all paragraphs in order, and repeat only the overlap of a cut one."""
    # No character comes twice, so that a piece shows where it is from.
    texts = ["\n\n".join("".join(chr(0x4E00 + sum(sizes[:n]) + k) for k in range(size)) for n, size in enumerate(sizes)) for sizes in bodies]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    for r in df.select("body", chunking.pieces(F.col("body"), most, overlap).alias("p")).collect():
        assert all(0 < len(x) <= most for x in r.p)
        letters, seen = r.body.replace("\n", ""), 0
        for x in r.p:
            flat = x.replace("\n", "")
            at = letters.index(flat)
            assert at <= seen <= at + overlap
            seen = at + len(flat)
        assert seen == len(letters)


def test_chunk_ids(spark):
    df = spark.createDataFrame([("d", "## A b\nx\n## C\ny")], "doc_id string, text string")
    assert [r.chunk_id for r in chunking.chunks(df).orderBy("chunk_ix").collect()] == ["d-a-b-1", "d-c-2"]


def test_chunk_parameters():
    with pytest.raises(ValueError, match="overlap"):
        chunking.checked(10, 10)


# retrieval

CHUNKS = [("c", 1, "S", "apple banana apple"), ("c", 2, "S", "banana cherry"), ("c", 3, "T", "apple"), ("c", 4, "T", "dates"), ("c", 5, "T", "")]


def bm25_loop(docs, query):
    import math

    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for d in toks for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query.split()) for d in toks]


def test_bm25_against_loop(spark):
    df = spark.createDataFrame(CHUNKS, "scope string, key long, section string, text string")
    index = retrieval.bm25_index(df)
    q = spark.createDataFrame([("q", "apple apple cherry nothing")], "query_id string, question string")
    got = {r.key: r.score for r in retrieval.bm25_scores(index, q).collect()}
    want = bm25_loop([c[3] for c in CHUNKS], "apple apple cherry nothing")
    assert got == {k + 1: pytest.approx(v, abs=1e-6) for k, v in enumerate(want) if v}
    # A filter holds for results, not for statistics.
    hits = retrieval.search_bm25(index, q, 5, F.col("section") == "T").collect()
    assert [(r.key, r.score) for r in hits] == [(3, got[3])]


def test_dense_and_fusion(spark):
    vectors = spark.createDataFrame([("c", 1, [1.0, 0.0]), ("c", 2, [0.0, 1.0]), ("c", 3, [0.0, 0.0])], "scope string, key long, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<double>")
    got = [(r.key, r.rank, r.score) for r in retrieval.search_dense(vectors, q, 3).orderBy("rank").collect()]
    assert got == [(1, 1, 0.707107), (2, 2, 0.707107), (3, 3, 0.0)]
    a = spark.createDataFrame([("q", "c", k, r) for k, r in (("A", 1), ("B", 2), ("C", 3))], "query_id string, scope string, key string, rank long")
    b = spark.createDataFrame([("q", "c", k, r) for k, r in (("B", 1), ("A", 2), ("D", 3))], "query_id string, scope string, key string, rank long")
    fused = {r.key: (r.rank, r.score) for r in retrieval.fuse(a, b, 4).collect()}
    two, one_ = round(1 / 61 + 1 / 62, 9), round(1 / 63, 9)
    assert fused == {"A": (1, two), "B": (2, two), "C": (3, one_), "D": (4, one_)}


def test_unknown_strategy():
    with pytest.raises(ValueError, match="unknown strategy"):
        retrieval.search("x", None, None, None)


def test_hybrid_without_vectors_keeps_lexical_order(spark):
    df = spark.createDataFrame(CHUNKS, "scope string, key long, section string, text string")
    q = spark.createDataFrame([("q", "apple cherry")], "query_id string, question string")
    index = retrieval.bm25_index(df)
    order = lambda s: [r.key for r in retrieval.search(s, index, None, q).orderBy("rank").collect()]
    assert order("hybrid") == order("bm25")
    assert order("dense") == []


def test_query_scores(spark):
    ranked = spark.createDataFrame([("a", 1, "S", "one two"), ("a", 2, "S > X", "three four"), ("a", 3, "S", "five")], "query_id string, rank long, section string, text string")
    spans = spark.createDataFrame([("a", 0, "S", "three"), ("a", 1, "s > x", "FOUR"), ("a", 2, "S", "five"), ("a", 3, "Z", "one")], "query_id string, span_ix int, section string, quote string")
    queries = spark.createDataFrame([("a", 4), ("b", 2), ("c", 0)], "query_id string, n_expected int")
    by = ["query_id"]
    got = {r.query_id: r for r in evaluation.query_scores(queries, evaluation.span_matches(ranked, spans, by, 2), ranked, by, 2).collect()}
    assert (got["a"].hit, got["a"].recall, got["a"].mrr, got["a"].matched_ranks, got["a"].n_retrieved) == (True, 0.5, 0.5, [2, 2], 2)
    assert (got["b"].hit, got["b"].recall, got["b"].mrr, got["b"].matched_ranks) == (False, 0.0, 0.0, [])
    assert got["c"].n_expected == 0 and got["c"].recall == 0.0


# scoring


def values(spark, gold, said):
    row = spark.createDataFrame([(json.dumps(gold), json.dumps(said))], "g string, p string")
    return row.select(scoring.value_of_variant(F.parse_json("g")).alias("gold"), scoring.value_of_variant(F.parse_json("p")).alias("predicted"))


CASES = [
    ("numeric", 100, "105", True), ("numeric", 100, 106, False), ("numeric", 0, 1, True), ("numeric", "1,062", 1062, True), ("numeric", 5, None, False), ("numeric", None, "", True), ("numeric", "n/a", [], True),
    ("numeric", 1, True, False), ("numeric", 5, "nan", False), ("boolean", True, "Yes ", True), ("boolean", False, 0, True), ("boolean", True, "maybe", False), ("boolean", None, None, True), ("boolean", "x", "y", False),
    ("date", "2020-02-21", "2020-02", True), ("date", "2020-02-21", "2020-2", False), ("date", "2020", "2020-05-06", True), ("date", "2020-02-21", "2020-02-22", False), ("date", None, "2020", False), ("date", "soon", None, True),
    ("categorical", "PHASE_3", "phase 3", True), ("categorical", "--", "", True), ("categorical", "A", "B", False), ("string", " A  b\n", "a B", True), ("string", "", None, True), ("string", "a", "", False),
    ("free_text", "Same", "same", True), ("string", True, "true", True), ("string", 3, "3", True),
]


@pytest.mark.parametrize(("category", "gold", "said", "want"), CASES)
def test_scalar_scores(spark, category, gold, said, want):
    pairs = values(spark, gold, said).select("*", F.lit(category).alias("category"), F.lit("string").alias("item_type"), F.expr("cast(map() AS map<string,string>)").alias("subfields"), F.lit(None).cast("double").alias("tol_abs"), F.lit(None).cast("double").alias("tol_pct"))
    assert scoring.score_fields(pairs).first().score.correct is want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.lists(st.sampled_from(["", "a", "b", "c"]), max_size=5), st.lists(st.sampled_from(["", "a", "b", "d"]), max_size=5)), min_size=1, max_size=30))
def test_matched_items_are_the_multiset_intersection(spark, pairs):
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(pairs)], "i int, g array<string>, p array<string>")
    got = [r.n for r in df.select("i", scoring.matched_items(F.col("g"), F.col("p")).alias("n")).orderBy("i").collect()]
    assert got == [sum(((Counter(g) & Counter(p)) - Counter({"": 99})).values()) for g, p in pairs]


@pytest.mark.parametrize(
    ("item_type", "spec", "gold", "said", "want"),
    [
        ("object", {"name": "", "type": ""}, [{"name": "X y", "type": "a"}], [{"type": "b", "name": "x  Y"}], 1.0),
        ("object", {"type": ""}, [{"b": 1, "a": 2}], [{"a": 2, "b": 1}], 1.0),
        ("object", {"label": "", "name": ""}, [{"name": "n"}], [{"label": "l", "name": "n"}], 0.0),
        ("categorical", {}, ["Phase 2/3"], ["PHASE2_3"], 1.0),
        ("string", {}, ["a", "a"], ["A"], 0.6667),
        ("string", {}, [], "text", 1.0),
        ("string", {}, ["a"], [], 0.0),
    ],
)
def test_list_scores(spark, item_type, spec, gold, said, want):
    pairs = values(spark, gold, said).select("*", F.lit("list").alias("category"), F.lit(item_type).alias("item_type"), F.from_json(F.lit(json.dumps(spec)), "map<string,string>").alias("subfields"), F.lit(None).cast("double").alias("tol_abs"), F.lit(None).cast("double").alias("tol_pct"))
    assert scoring.score_fields(pairs).first().score.f1 == want


def test_gate(spark):
    cur = spark.createDataFrame([("a", 0.77), ("b", 0.8), ("c", 0.5), ("d", 0.7)], "model string, f1 double")
    base = spark.createDataFrame([("a", 0.80), ("b", 0.83), ("d", 0.9)], "model string, f1 double")
    got = {r.model: (r["pass"], r.delta, r.note) for r in scoring.gate(cur, base).collect()}
    assert got == {"a": (0.77 - 0.80 >= -0.03, -0.03, None), "b": (0.8 - 0.83 >= -0.03, -0.03, None), "c": (True, None, "no baseline"), "d": (False, -0.2, None)}
    assert [r.model for r in scoring.baseline_is_stale(cur, base).collect()] == ["c"]


# sources and plans


@pytest.fixture(scope="module")
def golden(tmp_path_factory):
    root = tmp_path_factory.mktemp("golden")
    for doc, title in (("d1", "Alpha"), ("d2", "Beta")):
        (root / doc).mkdir()
        (root / doc / "source.md").write_text(f"# {title}\n## Design\n{title} is a randomized trial of something.\n## Outcome\nThe primary outcome is recovery time in days.\n## Arms\nPlacebo arm and treatment arm were compared.\n## Safety\nNo adverse events were seen at all.\n")
        queries = [{"id": f"{doc}-1", "question": "primary outcome recovery", "expected_spans": [{"section": "Outcome", "quote": "recovery time in days"}, {"section": "Arms", "quote": "Placebo arm"}], "rationale": "r"}]
        (root / doc / "retrieval.json").write_text(json.dumps(queries))
        (root / doc / "golden.json").write_text(json.dumps({"title": title, "n": 10, "tags": ["a", "b"], "extra": 1, "nothing": None}))
    spec = {"documents": [{"doc_id": d, "fields": {"title": {"type": "string", "description": "t"}, "n": {"type": "integer", "description": "n", "tolerance": {"abs": 0, "pct": 0.0}}, "tags": {"type": "list", "item_type": "string", "description": "x"}, "nothing": {"type": "date", "description": "y"}}} for d in ("d1", "d2")]}
    (root / "spec.json").write_text(json.dumps(spec))
    (root / "runs").mkdir()
    runs = {"model": "m:1", "created_at": "2026-01-01T00:00:00+00:00", "extractions": {"d1": {"title": "alpha", "n": 11, "tags": ["b"], "nothing": None}, "d2": {"_error": "boom", "_error_type": "X"}}}
    (root / "runs" / "m-1.json").write_text(json.dumps(runs))
    (root / "runs" / "bad.json").write_text("{")
    return str(root)


def test_sources(spark, golden):
    assert [r.doc_id for r in readers.listed(spark, golden, ("source.md", "golden.json")).collect()] == ["d1", "d2"]
    assert readers.field_spec(spark, f"{golden}/spec.json").count() == 8
    assert readers.baseline(spark, f"{golden}/none.json").count() == 0
    assert readers.golden_queries(spark, f"{golden}/nowhere").count() == 0
    assert readers.missing_golden(readers.golden_records(spark, golden), ["d1", "d9"]) == ["d9"]


def test_run_eval(spark, golden):
    runs = readers.runs(spark, f"{golden}/runs/*.json")
    fields, docs, models = pipelines.run_eval(readers.field_spec(spark, f"{golden}/spec.json"), readers.golden_records(spark, golden), runs)
    got = {(r.doc_id, r.field): r.f1 for r in fields.collect()}
    assert got == {("d1", "title"): 1.0, ("d1", "n"): 0.0, ("d1", "tags"): 0.6667, ("d1", "nothing"): 1.0, ("d2", "title"): 0.0, ("d2", "n"): 0.0, ("d2", "tags"): 0.0, ("d2", "nothing"): 1.0}
    assert {r.doc_id: r.f1 for r in docs.collect()} == {"d1": 0.6667, "d2": 0.25}
    assert models.first().f1 == pytest.approx(0.4584, abs=1e-4)


def test_run_eval_unknown_document(spark, golden):
    runs = spark.createDataFrame([("m", "zz", "title", None)], "model string, doc_id string, field string, value string").withColumn("value", F.parse_json("value"))
    with pytest.raises(KeyError):
        pipelines.run_eval(readers.field_spec(spark, f"{golden}/spec.json"), readers.golden_records(spark, golden), runs)


def test_retrieval_eval(spark, golden):
    scores, report = pipelines.run_retrieval_eval(spark, golden, strategies=("bm25", "hybrid"), k=1)
    got = {(r.strategy, r.query_id): (r.hit, r.recall, r.mrr) for r in scores.collect()}
    assert got == {(s, f"{d}-1"): (True, 0.5, 1.0) for s in ("bm25", "hybrid") for d in ("d1", "d2")}
    assert {(r.strategy, r.doc_id): r.n_queries for r in report.collect()}["bm25", None] == 2


def test_cli(spark, golden, capsys):
    from rankloom import cli

    args = ["--golden", golden, "--spec", f"{golden}/spec.json", "--runs", f"{golden}/runs/*.json", "--baseline", f"{golden}/none.json"]
    assert cli.main([], spark) == 1
    assert cli.main([*args, "eval", "--regression"], spark) == 0
    assert cli.main([*args, "retrieval-eval", "--k", "0"], spark) == 0
    assert cli.main(["--golden", f"{golden}/none", "retrieval-eval"], spark) == 1
    assert cli.main(["--runs", f"{golden}/none/*.json", "eval"], spark) == 1
    assert "m:1" in capsys.readouterr().out


def test_run_sink_replaces_partitions(spark, golden, tmp_path):
    rows = readers.runs(spark, f"{golden}/runs/*.json").where("field IS NOT NULL").select("model", "doc_id", "field", "value")
    path = str(tmp_path / "runs")
    sinks.save_runs(rows, path)
    sinks.save_runs(rows.where("field = 'n'"), path)
    assert [(r.model, r.doc_id, r.field) for r in sinks.load_runs(spark, path).collect()] == [("m:1", "d1", "n")]


def test_run_summary_and_live(spark, golden):
    got = {r.doc_id: (r.failed, r.n_fields, r.n_null) for r in pipelines.run_summary(readers.runs(spark, f"{golden}/runs/*.json")).collect()}
    assert got == {"d1": (False, 4, 1), "d2": (True, 0, 0)}
    spec, gold, docs = readers.field_spec(spark, f"{golden}/spec.json"), readers.golden_records(spark, golden), readers.documents(spark, golden)
    live = pipelines.run_live(docs, spec, gold, lambda system, user: '{"title": "ALPHA", "n": 10, "tags": ["b", "a"]}', "m", "d1")
    assert {r.field: (r.equal, r.correct) for r in live.collect()} == {"title": (False, True), "n": (True, True), "tags": (False, True), "nothing": (True, True)}
    with pytest.raises(KeyError):
        pipelines.run_live(docs, spec, gold, None, "m", "d9")


def test_embedding_cache(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"h": "a", "v": [1, 2]}\nnot json\n{"h": "b"}\n\n{"h": "a", "v": [3]}\n')
    assert [(r.h, r.v) for r in readers.embedding_cache(spark, str(tmp_path / "c.jsonl"), "m").collect()] == [("a", [3.0])]


# models and validation


def test_retry():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise extraction.RateLimited("429")
        return x

    assert extraction.Retry(sleep=waits.append).call(flaky, 7) == 7
    assert waits == [1.0, 2.0]
    with pytest.raises(extraction.ModelError):
        extraction.Retry(retries=1, sleep=waits.append).call(lambda: (_ for _ in ()).throw(ConnectionError("x")))
    with pytest.raises(KeyError):
        extraction.Retry(sleep=waits.append).call(lambda: {}["k"])


@pytest.mark.parametrize("text", ['```json\n{"a": 1}\n```', '```\n{"a": 1}```', ' {"a": 1} '])
def test_parse_object(text):
    assert extraction.parse_object(text) == {"a": 1}


@pytest.mark.parametrize("text", ["", None, "[1]", "{", "```json\nx```"])
def test_parse_object_refuses(text):
    with pytest.raises(extraction.BadAnswer):
        extraction.parse_object(text)


def test_judge_and_pending(spark):
    pairs = spark.createDataFrame([(1, "f", "g", "p"), (2, "f", "g", "g")], "id int, field string, gold string, predicted string")

    def ask(system, user):
        got = json.loads(user)
        return json.dumps({"correct": got["gold"] == got["candidate"], "reason": "r"})

    assert {r.id: r.correct for r in extraction.judge(pairs, ask, "s").collect()} == {1: False, 2: True}
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    done = spark.createDataFrame([("m", "a", None), ("m", "b", "boom")], "model string, doc_id string, error string")
    assert [r.doc_id for r in extraction.pending(docs, done, "m").collect()] == ["b"]


def test_secret_lines(spark):
    df = spark.createDataFrame([(1, "x\nAKIA" + "A" * 16 + "\nBEGIN RSA PRIVATE KEY sk-" + "a" * 20), (2, "clean")], "id int, text string")
    assert {(r.id, r.line_no, r.pattern) for r in validation.secret_lines(df, "id", "text").collect()} == {(1, 2, "aws_access_key"), (1, 3, "private_key"), (1, 3, "sk_key")}
    assert {r.pattern: r.n_lines for r in validation.secret_counts(df, "id", "text").collect()}["slack_token"] == 0


def test_golden_rules(spark):
    schema = "text string, g string, queries array<struct<id: string, question: string, expected_spans: array<struct<section: string, quote: string>>>>"
    good = ("x" * 500, '{"nct_id": "NCT1", "enrollment_count": 3, "arms": ["a"]}', [("q", "?", [("s", "t"), ("s", "u")])] * 5)
    bad = ("x", '{"nct_id": "1", "enrollment_count": "3", "arms": []}', [("q", None, [("s", "t")])] * 4)
    df = spark.createDataFrame([good, bad], schema).withColumn("golden", F.parse_json("g")).withColumn("e", F.monotonically_increasing_id())
    rows = validation.constraints(df, F.length("text"), validation.golden_rules(["nct_id"], ["arms"]))
    assert rows.where("entity = 500 AND NOT ok").count() == 0
    failed = {r.rule for r in rows.where("entity = 1 AND NOT ok").collect()}
    assert failed == {"source_size", "query_count", "query_keys", "span_count", "nct_id", "enrollment_count", "filled_arms"}


def test_rolling_hit_rate_streams(spark, tmp_path):
    from rankloom.streaming.drift import rolling_hit_rate

    rows = spark.createDataFrame([("2026-01-01 00:10:00", "bm25", True, 1.0), ("2026-01-01 00:20:00", "bm25", False, 0.0), ("2026-01-03 00:00:00", "bm25", True, 0.5)], "t string, strategy string, hit boolean, mrr double")
    path = str(tmp_path / "in")
    rows.select(F.to_timestamp("t").alias("ts"), "strategy", "hit", "mrr").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, strategy string, hit boolean, mrr double").parquet(path)
    query = rolling_hit_rate(stream, window="1 hour", slide="1 hour").writeStream.outputMode("append").format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.hit_rate, r.n) for r in spark.table("hits").collect()] == [(0.5, 2)]
