"""Further cases of the operators: rows that repeat at a cut, contracts of the queries, large groups, brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import common, graph, mixing, simhash, token_files, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def leaf(spark, rows):
    return spark.createDataFrame([(i, " ".join(["w"] * n), "en", "s1", None) for i, n in rows], DOCS).repartition(3)


@pytest.mark.parametrize("total", [0, 10, 25, 30, 40, 55, 80])
def test_mixture_takes_its_budget_of_repeated_rows(spark, total):
    from pyspark.sql import functions as F

    docs = leaf(spark, [(7, 10)] * 4)
    light = common.saved(mixing.leaves_of(docs), "light")
    leaves = common.saved(mixing.plan(light, mixing.budgets(light, F.lit(total))), "plan")
    got = mixing.selected(light, leaves).collect()
    assert sum(r.take_tokens for r in got) == total
    assert sorted(r.take_tokens for r in got if r.take_tokens) == sorted([10] * (total // 10) + ([total % 10] if total % 10 else []))


def test_mixture_of_repeated_rows_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.choice([3, 5])) for _ in range(60)]
    docs = leaf(spark, rows).unionByName(leaf(spark, [(100 + n, 4) for n in range(5)]).withColumn("source", __import__("pyspark").sql.functions.lit("s2")))
    got = mixing.mix(docs).collect()
    budget = mixing.budgets(common.saved(mixing.leaves_of(docs), "light")).collect()
    assert {r.source: r.budget for r in budget} == {s: sum(r.take_tokens for r in got if r.source == s) for s in ("s1", "s2")}
    whole = mixing.mixed_documents(docs)
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in got)


# tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return {k: Tokenizer.from_file(tokens.vocabulary(f)) for k, f in (("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json"))}


ALPHABET = ["a", "B", "the", " ", " ", "  ", "\n", "\n", "'s", "'", "1", "22", ".", ",", "é", "ñ", "  \n ", "!", "ı", "&&"]
STRANGE = ["\t", "日", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "ǅ", "\xa0", "e\u0301"]


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_encoder_equals_the_plain_call(plain, kind):
    rng = random.Random(1)
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json" if kind == "word" else "byte_bpe_50k.json"), kind, "ids")
    for turn in range(150):
        texts = ["".join(rng.choice(ALPHABET + (STRANGE if turn % 3 == 0 else [])) for _ in range(rng.randint(0, 14))) for _ in range(30)]
        if turn == 75:
            e._forget()
        ids, ends = e.encode_many(pa.array(texts))
        want = [x.ids for x in plain[kind].encode_batch(texts, add_special_tokens=False)]
        assert np.diff(ends, prepend=0).tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_queries_follow_the_plain_call(spark, plain, tmp_path):
    texts = ["one <|endoftext|> two", "a<|startoftext|>b", None, "", "plain words"]
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    from rankloom.llm import packing

    want = {i: [*plain["byte"].encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.op5_token_files(spark, str(tmp_path)).collect()}
    assert got == {i: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in want.items()}
    want = {i: [*plain["word"].encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.op4_cost_balanced_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in want.items()}


def test_ids_beyond_16_bits(spark):
    assert tokens.id_type(65_536) == np.dtype("<u2") and tokens.id_type(65_537) == np.dtype("<u4")
    wide = [np.array([70_000, 5, 70_000, 1], "<u4"), np.array([200_000], "<u4")]
    ids = spark.createDataFrame([(n, 4, bytearray(w.tobytes())) for n, w in enumerate(wide)], "doc_id long, width int, ids binary")
    ranks = token_files.rank_table(ids)
    assert ranks.tolist() == [70_000, 1, 5, 200_000]
    path = common.new_path(spark, "wide")
    token_files.write_files(ids, ranks, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_files(spark, path, ranks).collect()}
    assert got == {0: (0, 4, zlib.crc32(wide[0].tobytes())), 1: (4, 1, zlib.crc32(wide[1].tobytes()))}


# near duplicates


def variants(rng, words, n):
    return [" ".join(w if rng.random() > 0.01 else f"x{rng.random()}" for w in words) for _ in range(n)]


@pytest.mark.parametrize("near_block", [5, 16, 256])
def test_one_large_group_of_near_copies(spark, near_block):
    """A group over many blocks, with members that only some others reach, and strays in its shards."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = variants(rng, base, 60)
    chain = list(base)
    for _ in range(12):  # each is near the last, the ends are far apart
        k = rng.randrange(100)
        chain[k : k + 3] = [f"y{rng.random()}" for _ in range(3)]
        texts.append(" ".join(chain))
    texts += [" ".join(base[:60] + [f"z{rng.random()}" for _ in range(60)]) for _ in range(10)]
    rows = list(enumerate(texts))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), near_block=near_block).collect()}
    assert got == {i: root(i) for i in sets if root(i) != i}


def test_hot_keys_are_joined_whole(spark):
    rows = [(n % 3 if n % 5 else 9, n) for n in range(3000)] + [(None, -1)]
    left = spark.createDataFrame(rows, "k long, n long")
    right = spark.createDataFrame([(0, "a"), (9, "b")], "k long, v string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, graph.joined_on(left, right, "k", how).collect()), key=str) == want


def test_contracted_links_connect_the_same(spark):
    rng = random.Random(2)
    links = [(rng.randrange(500), rng.randrange(500)) for _ in range(400)]
    a, b = graph.forest(*np.array(links).T)
    same = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    again = graph.components(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")).collect()
    assert sorted(same) == sorted(again) and len(a) == len(set(b.tolist()))


# toxicity


def test_score_against_brute_force():
    """The sum over word beginnings, found by looking at each word with each entry."""
    import math

    rng = random.Random(4)
    lexicon = {"idiot": 3.0, "idio": 0.5, "scum": 1.2, "tras": 0.4, "trash": 2.0}
    a = toxicity.automaton(lexicon)
    for _ in range(300):
        words = [rng.choice(["idiot", "idiots", "scum", "scummy", "trash", "tras", "can", "bin", "word", "xidiot", "the"]) for _ in range(rng.randint(0, 12))]
        total, seen = 0.0, Counter()
        for n, w in enumerate(words):
            if w == "trash" and n + 1 < len(words) and words[n + 1] in ("can", "bin"):
                continue
            best = max(((v, s) for s, v in lexicon.items() if w.startswith(s)), default=None)
            if best:
                seen[best[1]] += 1
                total += best[0] / seen[best[1]]
        want = 1 - math.exp(-total / (1 + math.log10(1 + (len(words) + 1) / toxicity.LENGTH))) if words else 0.0
        assert toxicity.score_text(" ".join(words), a)[0] == pytest.approx(want)


def test_learning_on_executors_is_learning_at_hand(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = documents.join(labels, "doc_id").where("toxic IS NOT NULL").select("doc_id", "text", "toxic").collect()
    at_hand = toxicity.learn_lexicon([(r.text or "", r.toxic) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5])
    assert toxicity.learned(documents, labels) == at_hand


def test_toxicity_recall_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score(documents, toxicity.learned(documents, labels)).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits >= 0.9 * sum(r.toxic for r in got) and hits >= 0.9 * sum(r.predicted for r in got)


# media, licences, quality


def test_area_resize_by_bands(monkeypatch):
    from rankloom.llm import media

    x = np.random.default_rng(2).integers(0, 256, (37, 13)).astype(np.uint8)
    want = media.area_resize(x, 8, 9)
    fine = np.kron(x.astype(float), np.ones((8, 9))).reshape(8, 37, 9, 13).mean(axis=(1, 3))
    assert np.allclose(want, fine)
    for band in (1, 2, 5, 36, 37):
        monkeypatch.setattr(media, "BAND", band)
        assert np.allclose(media.area_resize(x, 8, 9), want)


def test_feature_of_the_query_by_brute_force(spark):
    """The difference hash of the stored payload, from exact area means by fractions."""
    from fractions import Fraction

    from rankloom.llm import media

    rng = random.Random(5)
    rows = [(n, "".join(rng.choice("abc xyzÄ") for _ in range(size))) for n, size in enumerate((0, 1, 64, 700, 5000))]
    got = {r.doc_id: r.feature for r in media.read_back(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for n, text in rows:
        raw = text.encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        image = [list(raw[k : k + 64]) for k in range(0, len(raw), 64)]
        share = lambda size, parts, k: [(i, min(Fraction(size * (k + 1), parts), i + 1) - max(Fraction(size * k, parts), i)) for i in range(size) if min(Fraction(size * (k + 1), parts), i + 1) > max(Fraction(size * k, parts), i)]
        small = [[sum(a * b * image[i][j] for i, a in share(len(image), 8, r) for j, b in share(64, 9, c)) for c in range(9)] for r in range(8)]
        bits = "".join("1" if small[r][c] < small[r][c + 1] else "0" for r in range(8) for c in range(8))
        assert got[n] == f"{int(bits, 2):016x}"


def test_samples_are_scaled():
    from rankloom.llm import media

    assert media.decode(b"P5 3 1 15\n\x00\x07\x0f").tolist() == [[0, 119, 255]]
    with pytest.raises(ValueError, match="compression 3"):
        media.decode(b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\x01\x00\x20\x00\x03" + bytes(40))


def test_full_licence_texts():
    from rankloom.llm import licenses

    known = [licenses.Templates(t) for t in (licenses.TEMPLATES, licenses.HEADERS, licenses.TEXTS)]
    scan = lambda text: licenses.own_license(text, known[0], headers=known[1], whole=known[2])[0]
    for name, (text,) in licenses.TEXTS.items():
        wrapped = "Copyright (c) 2021, Some Body\nAll rights reserved.\n\n" + "\n".join(text[k : k + 70] for k in range(0, len(text), 70)).replace("\n", " \n")
        assert scan("Copyright (c) 2021, Some Body\n\n" + text) == name
        assert wrapped
    assert scan("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989") == "GPL-2.0"
    assert scan("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\nx") == "GPL-3.0"
    assert scan("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n") == "LGPL-3.0"
    assert scan("                                 Apache License\n                           Version 2.0, January 2004\n") == "Apache-2.0"
    assert scan("Mozilla Public License Version 2.0\n==================================\n") == "MPL-2.0"


def test_cosine_by_brute_force():
    """Templates.best() against dense vectors over all words."""
    import math

    from rankloom.llm import licenses

    t = licenses.Templates(licenses.TEMPLATES)
    rng = random.Random(6)
    lists = [(name, licenses.words(x)) for name in sorted(licenses.TEMPLATES) for x in licenses.TEMPLATES[name]]
    vocabulary = sorted({w for _, ws in lists for w in ws} | {"other", "words"})
    for _ in range(200):
        ws = rng.sample(vocabulary, 6) + rng.choice(lists)[1][: rng.randint(1, 9)]
        dense = lambda xs: [xs.count(w) * t.idf.get(w, t.rare) for w in vocabulary]
        v, best = dense(ws), (0.0, None)
        for name, xs in lists:
            if name in t.versions and not any(t.versions[name].fullmatch(w) for w in ws):
                continue
            u = dense(xs)
            c = round(sum(a * b for a, b in zip(u, v)) / math.sqrt(sum(a * a for a in u)) / math.sqrt(sum(a * a for a in v)), 9)
            if c > best[0]:
                best = (c, name)
        found = t.best(ws)
        assert found[0] == pytest.approx(best[0], abs=2e-9) and (found[1] == best[1] or best[0] == pytest.approx(found[0], abs=2e-9))
