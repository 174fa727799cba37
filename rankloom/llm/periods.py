"""Runs of periodically repeated words in documents by an all-lag scan (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(LEAST, 2 * q) words
long, that no neighbouring word extends. Words become ids; for each lag q from 1 to n / 2 (2: the least exponent) the id array
is compared with itself shifted by q, many lags in one NumPy operation, and stretches of equal ids are measured: a stretch of
length L at lag q is a run of L + q words. A stretch whose smallest period is a divisor of q belongs to that lag.

Short texts are scanned where they lie. A text over LONG bytes is dealt out as ranges of lags, so that its quadratic work
(about 3 n^2 / 8 comparisons) is shared by many tasks; their runs are gathered by text (fewer than n), and joined back.

Defined cases: null or empty text has no words and no runs; whole texts are scanned, however long; overlapping runs and runs of
different periods at one place are all given; rows that repeat are rows of their own with equal results, whatever their doc_id
(null too); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, slices, table, values

#: Words of the shortest run.
LEAST = 12
#: Comparisons of one NumPy operation, so bytes of its result.
CELLS = 1 << 21
#: Bytes of text beyond which lags are dealt out, and bytes of text that a range of lags has at most one of.
LONG, RANGE_BYTES = 60_000, 15_000
_RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: ASCII white space, at which bytes.split() splits too.
SPACE = r"[\x20\x09-\x0D]+"


def ids_of(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    return ids.astype(np.uint16 if len(known) < 65_000 else np.uint32)


def stretches(ids: np.ndarray, low: int, high: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, lags) of the maximal stretches with a period of low <= lag < high that are long enough for a run."""
    n, found = len(ids), []
    shifted = np.concatenate([ids, np.full(high + 1, np.iinfo(ids.dtype).max, dtype=ids.dtype)])  # no id: nothing equals it
    at = low
    while at < high:
        width = n - at + 1  # the last column never matches, so that stretches end with their row
        stop = min(at + max(CELLS // width, 1), high)
        rows = np.lib.stride_tricks.sliding_window_view(shifted[at : stop - 1 + width], width)
        hits = np.flatnonzero(rows == ids[:width])
        if len(hits):
            last = np.flatnonzero(np.append(np.diff(hits) != 1, True))
            first = hits[np.append(0, last[:-1] + 1)]
            lag = at + first // width
            length = hits[last] - first + 1 + lag
            good = length >= np.maximum(least, 2 * lag)
            found.append((first[good] % width, length[good], lag[good]))
        at = stop
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _primes(q: int) -> list[int]:
    """Prime divisors of q."""
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def runs_of(ids: np.ndarray, low: int, high: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with low <= period < high, in that order."""

    def primitive(start: int, length: int, q: int) -> bool:
        piece = ids[start : start + length]
        return not any(np.array_equal(piece[q // p :], piece[: length - q // p]) for p in _primes(q))

    rows = zip(*(x.tolist() for x in stretches(ids, low, high, least)), strict=True)
    return sorted((s, n, q) for s, n, q in rows if primitive(s, n, q))


def lags(n: int, part: int = 0, parts: int = 1) -> tuple[int, int]:
    """The part's range of the lags 1 to n / 2."""
    most = n // 2
    return 1 + most * part // parts, 1 + most * (part + 1) // parts


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run holds after its first period, joined by blanks."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return b" ".join(words if not gone.any() else [words[i] for i in np.flatnonzero(~gone).tolist()])


def _dicts(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def _finished(rows: DataFrame, least: int, known: bool) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of (doc_id, text[, runs]): runs are found here unless they are known."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN_TYPE), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            columns: tuple[list, list, list] = ([], [], [])
            given = b.column(2).to_pylist() if known else [None] * b.num_rows
            for text, have in zip(values(b.column(1)), given, strict=True):
                words = (text or b"").split()
                found = [(r["start"], r["length"], r["period"]) for r in have or ()] if known else runs_of(ids_of(words), *lags(len(words)), least)
                for column, x in zip(columns, (len(words), _dicts(found), collapsed(words, found).decode()), strict=True):
                    column.append(x)
            yield batch(out, [b.column(0), *columns])

    kept = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["runs"] if known else []))
    return kept.mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def _dealt(long: DataFrame, least: int, range_bytes: int) -> DataFrame:
    """(digest, runs) of texts, each scanned in ranges of lags."""
    out = pa.schema([("digest", pa.string()), ("part", pa.int32()), ("runs", _RUN_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=1):
            digest, part, parts, text = (values(c)[0] for c in b.columns)
            ids = ids_of(text.split())
            yield batch(out, [[digest], [part], [_dicts(runs_of(ids, *lags(len(ids), part, parts), least))]])

    size = F.octet_length("text").cast("double")
    parts = F.greatest(F.lit(1), F.least(F.ceil(size * size / (LONG * LONG)), F.ceil(size / range_bytes))).cast("int")
    texts = long.groupBy("digest").agg(F.first("text").alias("text")).withColumn("parts", parts)
    units = texts.select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "text").repartition("digest", "part")
    found = units.mapInArrow(run, f"digest string, part int, runs {_RUNS}")
    return found.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))


def periodic_runs(docs: DataFrame, least: int = LEAST, long: int = LONG, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of docs (doc_id, text).

    runs: array<struct(start, length, period)> by start, then length; words are counted from 0. collapsed: the words that are left
    when runs keep their first period alone.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    is_long = F.octet_length("text") > long
    named = rows.where(is_long).withColumn("digest", F.sha2("text", 256))
    with_runs = named.join(_dealt(named, least, range_bytes), "digest", "left")
    return _finished(rows.where(~is_long), least, known=False).unionByName(_finished(with_runs, least, known=True))


def planted(text: Column, doc_id: Column) -> Column:
    """The query's texts: of a tenth of the documents, the words from one on repeat with a period that the doc_id draws."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i).cast("int"))), " "))

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    by_period = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"])))
    lines = F.array_join(F.transform(by_period, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
