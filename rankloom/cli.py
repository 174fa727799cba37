"""Command line: retrieval-eval, extract, eval, judged-eval, validate. Exit code 1 without input, on a regression and if all calls failed."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import Observation
from pyspark.sql import functions as F

from rankloom import storage
from rankloom.operators import chunking, extraction, file_rules, scoring, validation
from rankloom.plans import pipelines
from rankloom.session import build_session
from rankloom.sources import readers, sinks
from rankloom.sources.vector_cache import VectorCache
from rankloom.streaming import batch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankloom")
    p.add_argument("--golden", default="data/golden")
    p.add_argument("--spec", default="shared/schema.json")
    p.add_argument("--runs", default="evals/runs/*.json")
    p.add_argument("--baseline", default="evals/baseline.json")
    p.add_argument("--out", default=None)
    sub = p.add_subparsers(dest="command")
    r = sub.add_parser("retrieval-eval")
    r.add_argument("--doc", action="append")
    r.add_argument("--k", type=int, default=5)
    r.add_argument("--strategies", default="bm25", help="of bm25, dense and hybrid, with commas; the last two need an embedder")
    r.add_argument("--embedder", choices=("auto", "url", "server", "local", "none"), default="auto", help="auto: --embed-url if given, else --embed-server if it lists the model, else the local library, else none")
    r.add_argument("--embed-url", help="of an endpoint that is used as it is")
    r.add_argument("--embed-server", help="base address of an embedding server, which is asked for its models first")
    r.add_argument("--embed-model", default="embedding")
    r.add_argument("--local-model", default="all-MiniLM-L6-v2")
    r.add_argument("--cache", help="folder of the table of vectors, read and appended to")
    x = sub.add_parser("extract")
    x.add_argument("--model", required=True)
    x.add_argument("--doc", action="append")
    x.add_argument("--base-url", help="of a chat-completions endpoint; the key comes from the variable that --key-variable names")
    x.add_argument("--key-variable", default="CHAT_API_KEY")
    x.add_argument("--prompts", help="folder with system.txt")
    x.add_argument("--rate", type=float, help="calls a second, over all tasks")
    x.add_argument("--lanes", type=int, default=4, help="calls at a time")
    x.add_argument("--batch", type=int, default=16, help="documents whose answers are saved together; a stopped run asks no others twice")
    e = sub.add_parser("eval")
    e.add_argument("--all-models", action="store_true")
    e.add_argument("--mock-run", action="store_true", help="score the runs that are there; no model is called in any case")
    e.add_argument("--model", action="append")
    e.add_argument("--regression", action="store_true")
    j = sub.add_parser("judged-eval", help="eval with a judge for free text; the baseline is replaced if it lacks a model")
    j.add_argument("--judge-model", required=True)
    j.add_argument("--base-url")
    j.add_argument("--key-variable", default="CHAT_API_KEY")
    j.add_argument("--prompts", help="folder with judge.txt")
    j.add_argument("--model", action="append")
    v = sub.add_parser("validate", help="rules on the golden data and on the files of a folder")
    v.add_argument("--files", help="a folder whose files are checked too")
    v.add_argument("--documents", type=int, help="how many documents the specification has to have")
    return p


def retrieval_eval(spark, args, call=None) -> int:
    if not readers.listed(spark, args.golden, ("source.md", "retrieval.json")).limit(1).count():
        print("no golden documents", file=sys.stderr)
        return 1
    strategies = tuple(s for s in args.strategies.split(",") if s)
    vectors = {}
    if set(strategies) - {"bm25"}:
        found = (args.embed_model, call) if call else embedder(args)
        if found is None:
            print("no embedder: dense finds nothing, and hybrid keeps bm25's order", file=sys.stderr)
        else:
            vectors = _vectors(spark, args, *found)
    scores, report = pipelines.run_retrieval_eval(spark, args.golden, args.doc, args.k or 5, strategies, **vectors)
    print(sinks.table_text(report.orderBy("strategy", F.col("doc_id").asc_nulls_first())))
    if args.out:
        sinks.write_json(scores, f"{args.out}/retrieval")
    return 0


def embedder(args) -> tuple[str, extraction.Embed] | None:
    """(model, embedder) by --embedder: its vectors are stored under its own model's name."""
    known = {
        "url": (args.embed_model, lambda: extraction.http_embed(args.embed_url, args.embed_model) if args.embed_url else None),
        "server": (args.embed_model, lambda: extraction.served_embedder(args.embed_server, args.embed_model) if args.embed_server else None),
        "local": (args.local_model, lambda: extraction.local_embedder(args.local_model)),
    }
    names = {"auto": ("url", "server", "local"), "none": ()}.get(args.embedder, (args.embedder,))
    picked = extraction.pick_embedder([(n, known[n][1]) for n in names])
    return (known[picked[0]][0], picked[1]) if picked else None


def _vectors(spark, args, model, call) -> dict:
    """Vectors of chunks and questions, by the cache and the embedder; the cache is appended to."""
    chunks = chunking.chunks(readers.documents(spark, args.golden)).select("chunk_id", "text")
    asked = readers.golden_queries(spark, args.golden).select("query_id", F.col("question").alias("text"))
    cache = VectorCache(spark, args.cache or storage.fresh_path(spark, "vectors"))
    extraction.fill_cache(chunks.select("text").unionByName(asked.select("text")), cache, call, model)
    named = lambda df, key: cache.with_vectors(df, model).select(key, F.col("v").alias("vector"))
    return {"vectors": named(chunks, "chunk_id"), "query_vectors": named(asked, "query_id")}


def extract(spark, args, chat=None) -> int:
    """Documents without a successful row are asked for, by a stream that a later start goes on with; see streaming/batch.py."""
    docs = readers.documents(spark, args.golden)
    docs = docs if not args.doc else docs.where(F.col("doc_id").isin(*args.doc))
    if not docs.limit(1).count():
        print("no documents", file=sys.stderr)
        return 1
    if chat is None and args.base_url:
        chat = extraction.http_chat(args.base_url, args.model, os.environ.get(args.key_variable, ""))
    if chat is None:
        print("no chat endpoint: give --base-url", file=sys.stderr)
        return 1
    spec, out = readers.field_spec(spark, args.spec), args.out or "runs"
    unknown = [r.doc_id for r in extraction.unspecified(docs, spec).limit(10).collect()]
    if unknown:
        raise KeyError(f"documents without a field specification: {unknown}")
    system = readers.prompts(spark, args.prompts).get("system") if args.prompts else None
    done = batch.extract_all(spark, args.golden, spec, chat, args.model, out, args.doc, batch.Limits(args.batch, args.lanes, args.rate), **({"system": system} if system else {}))
    print(f"{done.asked - done.failed} of {done.asked} documents extracted")
    return 1 if done.asked and done.failed == done.asked else 0


def _runs(spark, args, names):
    """The runs of the models named (None: of all); None without any. Says how many files were skipped."""
    seen = Observation("run files")
    runs = readers.runs(spark, args.runs, seen)
    runs = runs if names is None else runs.where(F.col("model").isin(*names))
    n = runs.count()
    if n and seen.get["skipped"]:
        print(f"{seen.get['skipped']} of {seen.get['files']} run files skipped", file=sys.stderr)
    if not n:
        print("no runs", file=sys.stderr)
    return readers.runs(spark, args.runs).where(F.lit(True) if names is None else F.col("model").isin(*names)) if n else None


def evaluate(spark, args) -> int:
    names = None if args.all_models or not args.model else args.model
    if (runs := _runs(spark, args, names)) is None:
        return 1
    _, docs, models = pipelines.run_eval(readers.field_spec(spark, args.spec), readers.golden_records(spark, args.golden), runs)
    models = pipelines.failed_models(models, names or [])
    print(sinks.table_text(models.orderBy(F.desc("f1"), "model")))
    if args.out:
        sinks.write_json(docs, f"{args.out}/documents")
        sinks.write_json(models, f"{args.out}/summary")
    if not args.regression:
        return 0
    baseline = readers.baseline(spark, args.baseline)
    if not baseline.limit(1).count():
        print("no baseline; the gate is skipped", file=sys.stderr)
        return 0
    gate = scoring.gate(models, baseline)
    print(sinks.table_text(gate.orderBy("model")))
    return 0 if gate.agg(F.bool_and("pass")).first()[0] else 1


def judged_eval(spark, args, ask=None) -> int:
    """Scores of all runs, free text by a judge; the baseline is replaced if it lacks a model, and the gate asks the one before."""
    if (runs := _runs(spark, args, args.model)) is None:
        return 1
    if ask is None and args.base_url:
        ask = extraction.http_chat(args.base_url, args.judge_model, os.environ.get(args.key_variable, ""), timeout_s=90.0)
    if ask is None:
        print("no chat endpoint for the judge: give --base-url", file=sys.stderr)
        return 1
    system = (readers.prompts(spark, args.prompts).get("judge") if args.prompts else None) or "Is the candidate a correct extraction of the gold value? Answer with a JSON object of correct and reason."
    _, docs, models = pipelines.run_judged_eval(readers.field_spec(spark, args.spec), readers.golden_records(spark, args.golden), runs, ask, system)
    models = pipelines.failed_models(models, args.model or []).persist()  # a judge's verdicts are asked for once
    before = readers.baseline(spark, args.baseline)
    had = before.limit(1).count() > 0
    gate = sinks.table_text(scoring.gate(models, before).orderBy("model"))  # now, as the baseline may be replaced
    print(sinks.table_text(models.orderBy(F.desc("f1"), "model")))
    print(sinks.table_text(docs.orderBy("model", "doc_id")))
    if args.out:
        sinks.write_json(docs, f"{args.out}/documents")
        sinks.write_json(models, f"{args.out}/summary")
    if sinks.save_baseline(models, scoring.baseline_is_stale(models, before), args.baseline):
        print(f"baseline written to {args.baseline}")
    if had:
        print(gate)
    return 0


def validate(spark, args) -> int:
    """A summary by rule, and the rows that failed; 1 if an error failed."""
    rows = pipelines.golden_checks(spark, args.golden, args.spec, args.documents)
    if args.files:
        rows = rows.unionByName(file_rules.folder_rules(spark, args.files))
    rows = rows.persist()
    summary = validation.summary(rows).orderBy("passed", "rule")
    print(sinks.table_text(summary))
    print(sinks.table_text(rows.where("NOT ok").orderBy("severity", "rule", "entity")))
    return 0 if summary.agg(F.bool_and("passed")).first()[0] else 1


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.command:
        p.print_help()
        return 1
    spark = spark or build_session()
    return {"retrieval-eval": retrieval_eval, "extract": extract, "eval": evaluate, "judged-eval": judged_eval, "validate": validate}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
