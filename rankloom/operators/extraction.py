"""Calls to models from executors: chat answers as objects, judges, and embeddings, with injected transports.

A transport is any picklable callable. Calls are made in Arrow batches on executors, and a failed one gives
an error row instead of failing the job; retries and back-off follow `Retry`.
"""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import text_hash
from rankloom.operators.retrieval import cache_misses
from rankloom.sources.vector_cache import VectorCache

LOG = logging.getLogger(__name__)

#: (system, user) -> content of the answer, and text -> vector.
Chat = Callable[[str, str], str]
Embed = Callable[[str], list]


#: Columns of extract()'s answers, for documents whose ids are strings.
ANSWERS = "model string, doc_id string, value string, error string, error_type string"


class ModelError(RuntimeError):
    """A call that failed for good."""


class RateLimited(ModelError):
    """Status 429 or 5xx: worth another try."""


class BadAnswer(ModelError):
    """An answer that holds no JSON object."""


@dataclass(frozen=True)
class Retry:
    retries: int = 3
    base_s: float = 2.0
    sleep: Callable[[float], None] = time.sleep

    def call(self, f: Callable, *args):
        """f(*args), again after base ** attempt seconds on network errors and rate limits; other errors at once."""
        for attempt in range(self.retries + 1):
            try:
                return f(*args)
            except (RateLimited, ConnectionError, TimeoutError) as e:
                if attempt == self.retries:
                    raise e if isinstance(e, ModelError) else ModelError(f"request failed: {e}") from e
                self.sleep(self.base_s**attempt)
        raise AssertionError


def http_chat(base_url: str, model: str, api_key: str, timeout_s: float = 60.0, temperature: float = 0.0) -> Chat:
    """A transport for chat-completions endpoints, by the standard library."""

    def call(system: str, user: str) -> str:
        import urllib.request

        body = {"model": model, "temperature": temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        found = _fetched(urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"}), timeout_s)
        try:
            return found["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ModelError(f"unexpected response: {e!r}") from e

    return call


def _fetched(request, timeout_s: float):
    """The JSON that an endpoint answers; its errors as ModelError, those worth another try as RateLimited or ConnectionError."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise (RateLimited if e.code == 429 or e.code >= 500 else ModelError)(f"status {e.code}") from e
    except urllib.error.URLError as e:
        raise ConnectionError(str(e)) from e
    except ValueError as e:
        raise ModelError(f"unexpected response: {e}") from e


def http_embed(url: str, model: str, timeout_s: float = 30.0) -> Embed:
    """A transport for embedding endpoints that answer with `embeddings` or `embedding`."""

    def call(text: str) -> list:
        import urllib.request

        found = _fetched(urllib.request.Request(url, json.dumps({"model": model, "input": text}).encode(), {"Content-Type": "application/json"}), timeout_s)
        try:
            return found["embeddings"][0] if found.get("embeddings") else found["embedding"]
        except (KeyError, IndexError, TypeError, AttributeError) as e:
            raise ModelError(f"unexpected response: {e!r}") from e

    return call


def list_models(base_url: str, api_key: str = "", timeout_s: float = 10.0) -> list[str]:
    """Names of the models that an endpoint offers, in order."""
    import urllib.request

    found = _fetched(urllib.request.Request(f"{base_url.rstrip('/')}/models", headers={"Authorization": f"Bearer {api_key}"}), timeout_s)
    return sorted(str(m["id"]) for m in found.get("data", ()) if "id" in m)


def once_a_worker(load: Callable[[], Embed]) -> Embed:
    """An embedder whose model is loaded by its first call in each Python worker, and kept there for later batches and tasks."""
    return _Loaded(load)


class _Loaded:
    _kept: ClassVar[dict[str, Embed]] = {}

    def __init__(self, load: Callable[[], Embed]) -> None:
        self.load, self.name = load, uuid.uuid4().hex

    def __call__(self, text: str) -> list:
        if self.name not in _Loaded._kept:
            _Loaded._kept[self.name] = self.load()
        return _Loaded._kept[self.name](text)


#: An answer in a code fence, with or without the fence's language.
_FENCED = re.compile(r"\s*`{3,}\s*(?:json\b)?(?P<body>.*?)`*\s*", re.S | re.I)


def parse_object(content: str | None) -> dict:
    """The JSON object that an answer is, as a whole or within one code fence."""
    answer = content or ""
    fenced = _FENCED.fullmatch(answer)
    try:
        value = json.loads(fenced["body"] if fenced else answer)
    except ValueError as e:
        raise BadAnswer(f"no JSON: {e}") from e
    if isinstance(value, dict):
        return value
    raise BadAnswer(f"a JSON {type(value).__name__} in place of an object")


def prompt(spec: DataFrame) -> DataFrame:
    """(doc_id, fields): a line for each field in order, with its type, allowed values or item keys."""
    tail = (
        F.when(F.size("valid_values") > 0, F.concat(F.lit(" [one of: "), F.array_join("valid_values", ", "), F.lit("]")))
        .when((F.col("type") == "list") & (F.size("subfields") > 0), F.concat(F.lit(" [list of "), F.coalesce("item_type", F.lit("string")), F.lit(" with keys "), F.array_join(F.array_sort(F.map_keys("subfields")), ", "), F.lit("]")))
        .when(F.col("type") == "list", F.concat(F.lit(" [list of "), F.coalesce("item_type", F.lit("string")), F.lit("]")))
        .otherwise("")
    )
    line = F.concat(F.lit("- "), F.col("field"), F.lit(" ("), F.col("type"), F.lit("): "), F.coalesce("description", F.lit("")), tail)
    ordered = F.array_sort(F.collect_list(F.struct("field_ix", line.alias("line"))))
    return spec.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("fields"))


def extract(documents: DataFrame, spec: DataFrame, chat: Chat, model: str, system: str = "Extract the fields as one JSON object.", retry: Retry = Retry(), pause_s: float = 0.0) -> DataFrame:
    """(model, doc_id, value, error, error_type): one call a document; value is the answer's JSON object.

    KeyError before any call if documents have no field specification.
    pause_s: seconds that a task waits between its calls, so that tasks times calls a second stay under an endpoint's limit.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for n, (doc, text, fields) in enumerate(zip(frame.doc_id, frame.text, frame.fields, strict=True)):
                if n and pause_s:
                    retry.sleep(pause_s)
                try:
                    rows.append((model, doc, json.dumps(parse_object(retry.call(chat, system, f"{fields}\n\n{text}"))), None, None))
                except Exception as e:  # the row carries it
                    rows.append((model, doc, None, str(e), type(e).__name__))
            yield pd.DataFrame(rows, columns=["model", "doc_id", "value", "error", "error_type"])

    unknown = [r.doc_id for r in unspecified(documents, spec).limit(10).collect()]
    if unknown:
        raise KeyError(f"documents without a field specification: {unknown}")
    asked = documents.select("doc_id", "text").join(prompt(spec), "doc_id")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return asked.mapInPandas(run, f"model string, doc_id {kind}, value string, error string, error_type string")


def unspecified(documents: DataFrame, spec: DataFrame) -> DataFrame:
    """(doc_id) of documents that have no field specification."""
    return documents.select("doc_id").join(spec.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("doc_id")


def to_runs(answers: DataFrame, spec: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Long run rows (model, created_at, doc_id, field, value VARIANT, error, error_type): the spec's fields, or one row with the error."""
    fields = to_fields(answers.where("error IS NULL"), spec).withColumns({"error": F.lit(None).cast("string"), "error_type": F.lit(None).cast("string")})
    failed = answers.where("error IS NOT NULL").select("model", "doc_id", F.lit(None).cast("string").alias("field"), F.lit(None).cast("variant").alias("value"), "error", "error_type")
    stamped = fields.unionByName(failed).withColumn("created_at", F.current_timestamp() if created_at is None else created_at)
    return stamped.select("model", "created_at", "doc_id", "field", "value", "error", "error_type")


def to_fields(answers: DataFrame, spec: DataFrame) -> DataFrame:
    """Long rows (model, doc_id, field, value VARIANT) of the spec's fields; missing ones are null."""
    rows = answers.withColumn("whole", F.try_parse_json("value"))
    entries = F.from_json(F.to_json("whole"), "map<string,variant>")
    return rows.withColumn("entries", entries).join(spec.select("doc_id", "field"), "doc_id").select("model", "doc_id", "field", F.try_element_at("entries", F.col("field")).alias("value"))


def pending(documents: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Documents that the model has no successful row of yet: errors are tried again."""
    return documents.join(done.where((F.col("model") == model) & F.col("error").isNull()).select("doc_id"), "doc_id", "left_anti")


def judge(pairs: DataFrame, ask: Chat, system: str, retry: Retry = Retry()) -> DataFrame:
    """(id, correct, reason) of rows (id, field, gold, predicted) by a judge's verdict; a failed call isn't correct."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, field, gold, candidate in zip(frame.id, frame.field, frame.gold, frame.predicted, strict=True):
                try:
                    verdict = parse_object(retry.call(ask, system, json.dumps({"field": field, "gold": gold, "candidate": candidate})))
                    rows.append((key, bool(verdict.get("correct", False)), str(verdict.get("reason", ""))))
                except ModelError as e:
                    rows.append((key, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "correct", "reason"])

    return pairs.select("id", "field", "gold", "predicted").mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, correct boolean, reason string")


def embed(texts: DataFrame, call: Embed, model: str, retry: Retry = Retry()) -> DataFrame:
    """(model, h, v, error) of distinct texts (h, text); a failed call has a null vector and its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for h, text in zip(frame.h, frame.text, strict=True):
                try:
                    rows.append((model, h, [float(x) for x in retry.call(call, text)], None))
                except Exception as e:  # the row carries it
                    rows.append((model, h, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["model", "h", "v", "error"])

    return texts.select("h", "text").mapInPandas(run, "model string, h string, v array<double>, error string")


def embedded(chunks: DataFrame, cache: DataFrame, call: Embed, model: str, text: str = "text", retry: Retry = Retry()) -> tuple[DataFrame, DataFrame]:
    """(chunks with their vector, new cache rows): what the model's cache misses is embedded; failed ones stay misses."""
    known = cache.where(F.col("model") == model)
    new = embed(cache_misses(chunks, known, text), call, model, retry).where("error IS NULL").drop("error")
    return with_vectors(chunks, known.select("model", "h", "v").unionByName(new), text), new


def fill_cache(texts: DataFrame, cache: VectorCache, call: Embed, model: str, retry: Retry = Retry()) -> None:
    """Embed what the cache misses of texts (text), and store it; failed ones stay misses."""
    cache.append(embed(cache.misses(texts, model), call, model, retry).where("error IS NULL"), model)


def letter_embedder(text: str) -> list[float]:
    """An embedder without a model: counts of the letters a to z."""
    low = (text or "").lower()
    return [float(low.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"]


def with_vectors(chunks: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """chunks with their cached vector v."""
    return chunks.withColumn("h", text_hash(text)).join(cache.select("h", "v").dropDuplicates(["h"]), "h").drop("h")


def pick_embedder(candidates: list[tuple[str, Callable[[], Embed | None]]]) -> tuple[str, Embed] | None:
    """The first embedder that can be had, by name; resolved once, on the driver. Why others can't be had is logged."""
    for name, resolve in candidates:
        try:
            if (found := resolve()) is not None:
                return name, found
            LOG.info("embedder %s is not to be had", name)
        except (ModelError, OSError, ImportError, ValueError) as e:
            LOG.warning("embedder %s is not to be had: %s: %s", name, type(e).__name__, e)
    return None


def served_embedder(base_url: str, model: str, probe_s: float = 2.0) -> Embed | None:
    """An embedding server's transport, if it answers and lists exactly this model; else None or the error."""
    import urllib.request

    found = _fetched(urllib.request.Request(f"{base_url.rstrip('/')}/api/tags"), probe_s)
    return http_embed(f"{base_url.rstrip('/')}/api/embed", model) if model in {m.get("name") for m in found.get("models", ())} else None


def local_embedder(model: str) -> Embed:
    """A sentence-embedding model of the optional library, loaded once a worker; ImportError without it."""
    import sentence_transformers  # noqa: F401

    return once_a_worker(lambda: _local_model(model))


def _local_model(model: str) -> Embed:
    from sentence_transformers import SentenceTransformer

    loaded = SentenceTransformer(model)
    return lambda text: [float(x) for x in loaded.encode([text], normalize_embeddings=True)[0]]
