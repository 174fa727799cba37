"""Periodic runs, substring dedup and the point-in-time join: brute force on small tables, and the defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import asof, periods, substrings

DOCS = "doc_id long, text string, source string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def runs_by_hand(words, least=12):
    """Each start and end with its smallest period, kept if it is long enough and neither neighbour goes on with the period."""
    n, out = len(words), []
    for start in range(n):
        for end in range(start + least, n + 1):
            piece = words[start:end]
            q = next(q for q in range(1, len(piece) + 1) if piece[q:] == piece[: len(piece) - q])
            if len(piece) < 2 * q:
                continue
            more_left = start > 0 and words[start - 1] == words[start - 1 + q]
            more_right = end < n and words[end] == words[end - q]
            if not more_left and not more_right:
                out.append((start, len(piece), q))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_runs_by_hand(seed):
    rng = random.Random(seed)
    words = [rng.choice("ab" if seed % 2 else "abc").encode() for _ in range(rng.randrange(0, 25))]
    for _ in range(rng.randrange(3)):
        words += [rng.choice("abcd").encode() for _ in range(rng.randrange(1, 7))] * rng.randrange(2, 5)
    ids = periods.ids_of(words)
    n = len(words) // 2
    want = runs_by_hand(words)
    assert periods.runs_of(ids, 1, n + 1) == want
    parts = [r for k in range(3) for r in periods.runs_of(ids, *periods.lags(len(ids), k, 3))]
    assert sorted(parts) == want


def test_runs_with_few_cells_an_operation(monkeypatch):
    words = ([b"x", b"y", b"z"] * 9 + [b"q"] + [b"x", b"y"] * 11) * 2
    want = periods.runs_of(periods.ids_of(words), 1, len(words) // 2 + 1)
    monkeypatch.setattr(periods, "CELLS", 7)
    assert periods.runs_of(periods.ids_of(words), 1, len(words) // 2 + 1) == want
    assert (0, len(words), 50) in want


def contract_words(doc_id, text):
    words = text.encode().split() if text else []
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def contract_row(doc_id, text):
    words = contract_words(doc_id, text)
    runs = periods.runs_of(periods.ids_of(words), 1, len(words) // 2 + 1) if words else []
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    left = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(lines), sha(left))


def documents(spark, tmp_path, rows, name="documents", schema=DOCS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_op11_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "b", "ü", "d"]) for _ in range(rng.randrange(60))), "s") for i in range(150)]
    rows += [(500, None, "s"), (501, "", "s"), (502, "a\x1cb\x0b" * 40, "s"), (503, "w " * 30, "s"), (503, "w " * 30, "s"), (None, "a b " * 8, None)]
    d = documents(spark, tmp_path, rows)
    got = sorted([tuple(r) for r in periods.op11_periodic_runs(spark, d).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()], key=str)
    assert got == sorted([(i, *contract_row(i, t)) for i, t, _ in rows], key=str)


def test_long_texts_are_dealt_out_by_lags(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40, 90))) for _ in range(20)]
    docs = spark.createDataFrame([(i % 15, t) for i, t in enumerate(texts)] + [(3, texts[0]), (None, texts[0]), (4, None)], "doc_id long, text string")
    whole = sorted(map(str, periods.periodic_runs(docs).collect()))
    assert sorted(map(str, periods.periodic_runs(docs, long=60, range_bytes=20).collect())) == whole
    assert sorted(map(str, periods.periodic_runs(docs.withColumn("digest", F.lit("x")).withColumn("runs", F.lit(1))).collect())) == whole


def test_runs_of_no_rows(spark):
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Substring dedup


def repeats_by_hand(rows, window=20):
    """(doc_id, n_words, n_removed, kept) by the definition: a window goes if its words start earlier."""
    first = {}
    key = lambda d: -(1 << 63) if d is None else d
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, (key(doc), i)), (key(doc), i))
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = {j for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < (key(doc), i) for j in range(i, i + window)}
        out.append((doc, len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode()))
    return sorted(out, key=str)


def found_repeats(docs, **options):
    rows = substrings.without_repeats(docs, **options).collect()
    return sorted([(r.doc_id, r.n_words, sum(x.length for x in r.removed), r.kept) for r in rows], key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([f"w{rng.randrange(300)}", "ä", "the"])
    shared = [[word() for _ in range(rng.randrange(18, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [word() for _ in range(rng.randrange(25))] + rng.choice(shared)[rng.randrange(3) :]
        rows.append((rng.randrange(55), rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [rows[0], (None, rows[1][1]), (70, None), (71, ""), (72, "loop " * 90), (73, " ".join(shared[0] * 3))]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_by_hand(spark, seed):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = repeats_by_hand(rows)
    assert sum(r[2] for r in want) > 200
    assert found_repeats(docs) == want
    assert found_repeats(docs, chunk_bytes=700, probe_bytes=900) == want


def test_shorter_windows_and_blocks(spark):
    rows = passages(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_repeats(docs, window=7, block=3) == repeats_by_hand(rows, 7)
    assert found_repeats(docs, window=7, block=4) == repeats_by_hand(rows, 7)
    with pytest.raises(ValueError, match="block"):
        substrings.without_repeats(docs, window=7, block=5)


def test_removed_stretches_are_maximal(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[5:35], "y", *words[30:60]]))]
    found = {r.doc_id: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].removed == []
    assert [(x.start, x.length) for x in found[2].removed] == [(1, 30), (32, 30)]
    assert found[2].kept == "x y"


def test_repeats_of_no_rows_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.without_repeats(none).count() == 0
    rows = [(1, "a " * 25), (2, "a " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("chunk", "ord", "keys")})
    assert found_repeats(docs) == repeats_by_hand(rows)


def test_packed_numbers():
    rng = np.random.default_rng(1)
    numbers = np.sort(rng.integers(0, 1 << 50, 999, dtype=np.uint64))
    assert (substrings.unpacked(substrings.packed(numbers)) == numbers).all()
    assert len(substrings.unpacked(substrings.packed(numbers[:0]))) == 0


def test_a_chunks_text_is_not_shuffled(spark):
    docs = spark.createDataFrame(passages(1), "doc_id long, text string")
    plan = substrings.without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan  # the marks'; the table of texts is read by its buckets
    assert "Bucketed: true" in plan


# Point-in-time join

ASKS, VERSIONS = "k string, t long, n int", "k string, a long, z long, e long, id long, note string"


def winners_by_hand(asks, versions):
    out = []
    for k, t, n in asks:
        good = [v for v in versions if None not in (k, t, v[0], v[1], v[2]) and v[0] == k and v[1] <= t < v[2]]
        low = lambda x: -(1 << 63) if x is None else x
        best = max(good, key=lambda v: (low(v[3]), low(v[4])), default=None)
        out.append((k, t, n, *(best[3:6] if best else (None, None, None))))
    return sorted(out, key=str)


def joined(spark, asks, versions, bits):
    a, v = spark.createDataFrame(asks, ASKS), spark.createDataFrame(versions, VERSIONS)
    found = asof.point_in_time(a, v, "k", "t", F.col("a"), F.col("z"), [F.col("e"), F.col("id")], ["note"], bits)
    return sorted([tuple(r) for r in found.select("k", "t", "n", "winner.o0", "winner.o1", "winner.note").collect()], key=str)


@pytest.mark.parametrize(("seed", "bits", "span"), [(0, 2, 40), (1, 3, 700), (2, 8, 5000), (3, 1, 9), (4, 8, 1 << 40)])
def test_winners_by_hand(spark, seed, bits, span):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 5 + ["x", "y", None])
    time = lambda: rng.choice([None] + [rng.randrange(-span, span)] * 12)
    versions = []
    for i in range(120):
        a = time()
        z = None if a is None else a + rng.randrange(-2, rng.choice([3, span // 3 + 2, span]))
        versions.append((key(), a, z, rng.choice([None, 1, 2, 3]), i, f"n{i}"))
    asks = [(key(), time(), i) for i in range(150)] + [("hot", versions[0][1], 1)] * 3
    assert joined(spark, asks, versions, bits) == winners_by_hand(asks, versions)


def test_every_second_of_every_interval(spark):
    versions = [("k", a, z, a * 31 % 7, a * 100 + z, "") for a in range(-9, 24) for z in range(a, 24, 5)]
    asks = [("k", t, 0) for t in range(-12, 30)]
    assert joined(spark, asks, versions, 2) == winners_by_hand(asks, versions)


def test_no_versions_and_no_asks(spark):
    assert joined(spark, [("k", 1, 0)], [], 8) == [("k", 1, 0, None, None, None)]
    assert joined(spark, [], [("k", 1, 2, 0, 0, "")], 8) == []


def test_repeated_versions_and_ties(spark):
    versions = [("k", 1, 5, 2, 7, "x"), ("k", 1, 5, 2, 7, "x"), ("k", 1, 5, 2, 7, "y"), ("k", 0, 9, 1, 9, "z")]
    got = joined(spark, [("k", t, 0) for t in range(10)], versions, 2)
    assert len({r[5] for r in got if r[3] == 2}) == 1
    assert got == joined(spark, [("k", t, 0) for t in range(10)], versions[::-1], 2)


def op13_by_hand(docs, labels):
    drawn = lambda i, k: int(hashlib.sha256(str(i).encode()).hexdigest()[8 * k : 8 * k + 8], 16)
    source = {}
    for i, s, _, _ in docs:
        if i is not None and s is not None:
            source[i] = min(s, source.get(i, s))
    out = []
    for (i,) in labels:
        t = None if i is None else drawn(i, 3) % 50000
        best = None
        for j, s, n, lang in docs:
            if j is None or t is None or s is None or s != source.get(i):
                continue
            e = drawn(j, 0) % 50000
            arrival, expiry = e - 60 + drawn(j, 1) % 600, e + drawn(j, 2) % 900
            if e <= t and arrival <= t < expiry:
                best = max(best or (e, -arrival, j, n, lang), (e, -arrival, j, n, lang))
        age = t - best[0] if best else None
        status = "none" if best is None else "stale" if age > 120 else "fresh"
        out.append((i, t, best and best[2], age, status, *(best[3:] if status == "fresh" else (None, None))))
    return sorted(out, key=str)


def test_op13_against_brute_force(spark, tmp_path):
    docs = [(i, "hot" if i % 3 else f"s{i % 9}", i * 7, "en") for i in range(3000)] + [(None, "hot", 1, "de"), (5, "hot", 35, "en"), (9000, None, 3, "fr")]
    labels = [(i,) for i in range(0, 3100, 4)] + [(8,), (8,), (None,), (9000,)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    got = asof.op13_point_in_time(spark, str(tmp_path)).select("doc_id", "t", "version_id", "age", "status", "n_chars", "lang").collect()
    want = op13_by_hand(docs, labels)
    assert {r[4] for r in want} == {"none", "stale", "fresh"}
    assert sorted([tuple(r) for r in got], key=str) == want


# Embeddings


def test_large_and_small_vectors_keep_their_links(spark):
    from rankloom.llm import embeddings

    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e308, 0.99e308]), (4, [1e-310, 1e-310]), (5, [1.0, 1.0]), (6, [1e200, -1e200]), (7, None), (8, [0.0, 0.0]), (9, [float("inf"), 1.0]), (10, [2.0, 2.0]), (11, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("digest", F.lit("x")).withColumn("vector", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    together = {1, 2, 3, 4, 5, 10}
    assert got == {i: (6, 1, i == 1) if i in together else (6, 1, False) if i is None else (0, i, True) for i, _ in rows}
