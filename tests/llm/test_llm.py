"""The operators on small fixtures against brute force, round trips and held-out accuracy."""

import hashlib
import io
import itertools
import math
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rankloom.llm import catalog, common, embeddings, graph, licenses, media, mixing, packing, quality, secrets, simhash, token_files, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, fp int, s int, cell int"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "ing", "lo", "mi", "ka"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zz" + str(rng.random())[2:6]
    return " ".join(w)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (1, 2, 3, 4, 30, 80, 120, 200)]
    out = [None, "", "   \n", "One two", "one TWO", "É é ＡＢ", "日本語 text ≥ 😀", words(rng, 9000), *base]
    out += [base[5], base[6].upper(), *[changed(rng, base[6], 2) for _ in range(8)], *[changed(rng, base[7], 1) for _ in range(12)], changed(rng, base[4], 15)]
    out += ['password = "hunter2hunter2" x', "AKIA" + "Q" * 16 + " deadbeefdeadbeef", 'k = "s3cr3tV4lue99"\nclient_secret = k\n', "tok\ttoken:abcdefabcdefabcdef12 <|endoftext|>"]
    found = [(100 + i, t) for i, t in enumerate(out)]
    return [*found, found[9], (None, base[5]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    langs, sources = ["en", "de", None], ["src0", "src1", "src12", None, "x"]
    data = [(i, t, langs[n % 3], sources[n % 5], None if t is None else len(t), "n", "k", 1, 2, 3) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def smallest(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# secrets


def base_brute(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[2]) >= 12 else []
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [x for *_, x in sorted(found)]


def test_secret_scan(docs, rows):
    got = sorted(((r.doc_id or 0, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.scan(docs).collect()))
    brute = [base_brute(t or "") for _, t in rows]
    count = lambda b, k: sum(x.startswith(k) for x in b)
    assert got == sorted((i or 0, hashlib.sha256(",".join(b).encode()).hexdigest(), count(b, "assign"), count(b, "access"), count(b, "hex")) for (i, _), b in zip(rows, brute))


@pytest.mark.parametrize("text", ["token = secret: abcdefghijklmnop", "TOKEN='" + "a" * 12 + "' paſſword=abcdefabcdefabcd", "api_key:  x password==" + "b" * 20, "😀 apikey=" + "c" * 12 + "AKIA" + "D" * 30])
def test_base_spans(text):
    assert [f"{k}:{s}:{e}" for k, s, e in secrets.base_spans(text)] == base_brute(text)


def test_lexer_propagates_constants():
    text = 'value = "s3cr3tV4lue99"\nother = value\nclient_secret = other\nname = "just a long name here"\npassword = "changeme"\ndb:\n  passphrase: correct-Horse-7battery\n'
    spans = [text[s:e] for _, s, e in secrets.lexed_spans(text)]
    assert spans == ["s3cr3tV4lue99", "correct-Horse-7battery"]


def test_lexer_takes_whole_names():
    long = "db_passphrase_" + "of_the_primary_replica." * 8 + "value"
    text = f'{long} = "Xk29fPq7Lm31vRt8"\n--{long}=Xk29fPq7Lm31vRt9\n9{long}: Xk29fPq7Lm31vRt7\n'
    assert [text[s:e] for _, s, e in secrets.lexed_spans(text)] == ["Xk29fPq7Lm31vRt8", "Xk29fPq7Lm31vRt9", "Xk29fPq7Lm31vRt7"]
    assert secrets.lexed_pairs("= " + "a.-9" * 500_000 + "-" * 500_000) == []


def test_redact(docs, none):
    got = {r.doc_id: r for r in secrets.redact(docs).collect() if r.text and "[SECRET]" in r.text}
    assert len(got) == 4
    assert all(r.n_chars == len(r.text) and not secrets.all_spans(r.text)[0] for r in got.values())
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(none).count() == 0


# embeddings


@pytest.mark.parametrize(("block", "cell"), [(4096, 2048), (7, 25)])
def test_embeddings_against_brute_force(spark, block, cell):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = [list(map(float, c + rng.normal(size=8) * s)) for c in centres for s in (0.05, 0.2, 0.3, 0.6) for _ in range(6)]
    x += [x[0]] * 9 + [[2 * v for v in x[0]]] + list(rng.normal(size=(60, 8)).tolist())
    x += [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [], [1e-30] * 8, [1e30] * 8]
    ids = list(range(10, 10 + len(x)))
    df = spark.createDataFrame(list(zip(ids, x, ["z"] * len(x))), "vec_id long, embedding array<double>, weight string")
    good = {i: np.array(v) for i, v in zip(ids, x) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / math.sqrt(good[a] @ good[a]) / math.sqrt(good[b] @ good[b]) >= 0.95]
    n = {i: sum(i in p for p in links) for i in ids}
    low = smallest(ids, links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block, cell=cell).collect()}
    assert got == {i: (n[i], low[i], low[i] == i) for i in ids}


def test_a_block_over_the_slice_size():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4400, 24))
    x[4200:4260] = x[10:70] + rng.normal(size=(60, 24)) * 0.01  # over the slices' border
    x[4300:4320] = x[4280:4300] * 3 + rng.normal(size=(20, 24)) * 0.01  # within the last slice
    x[100:120] = x[80:100] + rng.normal(size=(20, 24)) * 0.01  # within the first one
    weight = rng.integers(1, 4, len(x))
    u = embeddings.unit(x)
    alike = u @ u.T >= 0.95
    np.fill_diagonal(alike, False)
    group = pa.table({"point": list(range(len(x))), "weight": weight.tolist(), "visitor": [False] * len(x), "vector": list(x), "first": [True] * len(x)})
    got = {p: n for p, n, _ in embeddings._compare(group, 0.95)}
    assert got == {p: int(weight[alike[p]].sum()) for p in np.flatnonzero(alike.any(axis=1)).tolist()} and len(got) == 200


def test_embeddings_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, None)], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embeddings.near_duplicates(odd).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)]


# media


def bmp(pixels, bits):
    h, w = pixels.shape[:2]
    if bits == 24:
        rows_, palette = [r[:, ::-1].tobytes() for r in pixels.astype(np.uint8)], b""
    else:
        rows_, palette = [r.tobytes() for r in pixels.astype(np.uint8)], b"".join(bytes([i, i, i, 0]) for i in range(256))
    body = b"".join(r + bytes(-len(r) % 4) for r in rows_[::-1])
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(palette)) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, 0, 0, 0, 0, 0) + palette + body


def test_decode():
    rng = np.random.default_rng(1)
    g, c = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (4, 3, 3))
    assert (media.decode(media.encode_pgm(g)) == g).all()
    assert (media.decode(b"P6 # x\n3 4 255\n" + c.astype(np.uint8).tobytes()) == c).all()
    assert (media.decode(b"P2\n2 2\n255\n1 2\n3 4\n") == [[1, 2], [3, 4]]).all()
    assert (media.decode(b"P1\n2 2\n1 0\n0 1\n") == media.decode(b"P4\n2 2\n\x80\x40")).all()
    assert (media.decode(b"P5 1 1 65535\n\x01\x02") == [[258]]).all()
    assert (media.decode(bmp(g, 8))[:, :, 0] == g).all()
    assert (media.decode(bmp(c, 24)) == c).all()
    for bad in (b"", b"P5 9 9 255\n", b"GIF89a", b"BM" + bytes(60), b"P9"):
        with pytest.raises(ValueError):
            media.decode(bad)


@pytest.mark.parametrize("shape", [(1, 64), (8, 9), (13, 5), (40, 64)])
def test_area_resize(shape):
    x = np.random.default_rng(2).integers(0, 256, shape).astype(float)
    fine = np.kron(x, np.ones((8, 9)))  # each target area is a whole number of these
    want = fine.reshape(8, shape[0], 9, shape[1]).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(x, 8, 9), want)


def test_tiles_round_trip():
    x = np.random.default_rng(2).integers(0, 256, (10, 7, 3)).astype(np.uint8)
    back = np.zeros_like(x)
    for i, j, tile in media.tiles(x, 4):
        t = np.load(io.BytesIO(tile))
        back[4 * i : 4 * i + t.shape[0], 4 * j : 4 * j + t.shape[1]] = t
    assert (back == x).all()


def test_media_query(docs, rows, none):
    got = sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature != "") for r in media.read_back(media.store_texts(docs)).collect())
    pay = [(i, raw := (t or "").encode(), raw + bytes(-len(raw) % 64 if raw else 64)) for i, t in rows]
    assert got == sorted((i or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), True) for i, raw, p in pay)
    assert media.read_back(media.store_texts(none)).count() == 0


def test_decode_column(spark):
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.arange(300).reshape(1, 300) % 256))), (2, bytearray(b"no")), (3, None)], "id long, m binary")
    got = {(r.id, r.tile_col): (r.width, r.error) for r in media.decode_column(df, "id", "m").collect()}
    assert got == {(1, 0): (300, None), (1, 1): (300, None), (2, None): (None, "neither Netpbm nor BMP"), (3, None): (None, None)}


# tokens, packing, files


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    out = {k: Tokenizer.from_file(tokens.vocabulary(f)) for k, f in (("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json"))}
    for t in out.values():
        t.encode_special_tokens = True
    return out


ODD = ["", "a", "don't  we'll\n\n  x 's", "  lead", "trail  ", "12,3.4''s !!'s", "İstanbul ŉ ſ ǅ", "日本語 text", "tab\tx", "é combining", "ñ ª²½ ¿que?", "a\xa0b", "\n \n", "x" * 3000, "<|endoftext|>"]


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_encoder_is_the_library(library, rows, kind):
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json" if kind == "word" else "byte_bpe_50k.json"), kind)
    for text in ODD + [t for _, t in rows if t] + ODD:
        assert e.encode(text).tolist() == library[kind].encode(text, add_special_tokens=False).ids


def test_assign_prefers_lowest_cost():
    assert packing.assign([5, 4, 3, 3], 8, 2) == [[(0, 0, 5), (3, 0, 3)], [(1, 0, 4), (2, 0, 3)]]
    cut = packing.assign([7, 7, 6], 10, 2)
    assert sorted(n for seq in cut for _, _, n in seq) == [3, 3, 7, 7] and all(sum(n for *_, n in seq) == 10 for seq in cut)


def test_packer_leaves_no_padding_but_the_last():
    rng = random.Random(1)
    sizes = [rng.randint(1, 300) for _ in range(2000)]
    p = packing.Packer(64, 640)
    out = [x for i, n in enumerate(sizes) for x in p.add(i, n)] + list(p.finish())
    fill = {}
    for _, _, n, seq, offset in out:
        assert fill.get(seq, 0) == offset
        fill[seq] = offset + n
    assert sorted(fill.values())[1:] == [64] * (len(fill) - 1)


def test_packing(docs, rows, none, library):
    pieces = packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    want = sorted((i or 0, [*library["word"].encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert all(p.length == len(p.ids) and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id or 0, p.start)):
        by_doc.setdefault((p.doc_id or 0, p.doc_tokens), []).extend(p.ids)
    single = [w for w in want if [x[0] for x in want].count(w[0]) == 1]
    assert all(by_doc[i, len(ids)] == ids for i, ids in single)
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)
    at = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert at.get(p.sequence_id, 0) == p.offset
        at[p.sequence_id] = p.offset + p.length
    assert max(at.values()) <= 2048
    assert packing.pack(none, tokens.vocabulary("word_bpe_49k.json")).count() == 0


def test_variable_length_code():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(0, 1 << b, 50) for b in (8, 16, 24, 32)]).astype(np.uint32)
    rng.shuffle(v)
    for n in (0, 1, 3, 4, 5, 200):
        assert (token_files.decode_values(*token_files.encode_values(v[:n]), n) == v[:n]).all()
    blob = token_files.write_shard([7, 9], [3, 2], v[:5])
    ids, sizes, back = token_files.read_shard(blob)
    assert (ids.tolist(), sizes.tolist(), back.tolist()) == ([7, 9], [3, 2], v[:5].tolist())
    with pytest.raises(ValueError, match="damaged"):
        token_files.read_shard(blob[:-1] + bytes([blob[-1] ^ 1]))


def test_token_files(spark, docs, rows, none, library, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 500)
    for df, source in ((docs, rows), (none, [])):
        ids = common.saved(token_files.tokenized(df, tokens.vocabulary("byte_bpe_50k.json")), "t")
        path = common.new_path(spark, "t")
        ranks = token_files.rank_table(ids)
        token_files.write_files(ids, ranks, path, 3)
        got = [(r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_files(spark, path, ranks).collect()]
        want = sorted((i if i is not None else -1, np.array([*library["byte"].encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in source)
        assert sorted((i, n, c) for i, _, n, c in got) == sorted((i, len(b) // 4, zlib.crc32(b)) for i, b in want)
        starts, total = [], 0
        for i, start, n, _ in sorted(got, key=lambda g: g[1]):
            assert start == total
            starts.append(i)
            total += n
        assert starts == sorted(starts)


# near duplicates


def fingerprint_brute(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_bk_tree():
    rng = random.Random(2)
    fps = [rng.getrandbits(10) for _ in range(300)]
    tree = simhash.BKTree()
    for n, f in enumerate(fps):
        tree.add(f, n)
    for f in fps[:40]:
        assert sorted(tree.search(f, 2)) == [n for n, g in enumerate(fps) if (f ^ g).bit_count() <= 2]


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_against_brute_force(docs, rows, none, block):
    fp = [(i, fingerprint_brute(t or "", 3)) for i, t in rows]
    distinct = {f for _, f in fp}
    root = smallest(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    low = {}
    for i, f in fp:
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.groups(docs, block=block).collect())
    assert got == sorted((i or 0, f"{f:016x}", low.get(root[f])) for i, f in fp)
    assert simhash.groups(none).count() == 0


def test_fingerprint_links_exactly(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(n)) & (1 << 64) - 1 for b in base for n in (0, 1, 1, 2, 2, 3)})
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=5).collect()
    want = smallest(range(len(fps)), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    at = {x: n for n, x in enumerate(signed)}
    assert smallest(range(len(fps)), [(at[r.a], at[r.b]) for r in links]) == want


def jaccard_brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None and i not in sets:
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
            sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    return smallest(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b])])


@pytest.mark.parametrize("blocks", [(2048, 256), (4, 3)])
def test_near_duplicates_against_brute_force(docs, rows, none, blocks):
    low = jaccard_brute(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, block=blocks[0], near_block=blocks[1]).collect()}
    assert got == {i: r for i, r in low.items() if i != r}
    kept = simhash.without_near_duplicates(docs, block=blocks[0], near_block=blocks[1])
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, r in low.items() if i == r) and ids.count(None) == 2
    assert simhash.without_near_duplicates(none).count() == 0


def test_near_duplicates_whatever_their_fingerprints(spark):
    rng = random.Random(6)
    pairs = []
    for n in [9] * 200 + [29] * 50:
        w = [f"w{rng.getrandbits(40):x}" for _ in range(n)]
        pairs.append((" ".join(w[:-1]) if n == 9 else " ".join([*w[:-5]]), " ".join(w)))  # 4 of 5 shingles, 20 of 25
    far = [(simhash.fingerprint(simhash.shingle_hashes(a, 5)) ^ simhash.fingerprint(simhash.shingle_hashes(b, 5))).bit_count() > 16 for a, b in pairs]
    assert sum(far) > 5
    rows_ = [(2 * k + m, t) for k, p in enumerate(pairs) for m, t in enumerate(p)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got == {(2 * k + 1, 2 * k) for k in range(len(pairs))}


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(n, n + 1) for n in range(400, 470)] + [(500, n) for n in range(501, 600)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == smallest(nodes, [x for x in links if x[0] != x[1]])


# mixing


def fill_brute(total, children):
    """Budgets of {key: (weight, capacity)} by repeated sharing."""
    out, left, open_ = dict.fromkeys(children, 0), min(total, sum(c for _, c in children.values())), dict(children)
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = [k for k, (w, c) in open_.items() if c <= level * w]
        if not full:
            return out | {k: math.floor(level * w) for k, (w, _) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[1]
            left -= out[k]
    return out


def test_mixture_against_brute_force(docs, rows, none):
    light = [r for r in mixing.leaves_of(docs).collect()]
    total = sum(r.n_tokens for r in light)
    leaf = {}
    for r in light:
        leaf[r.domain, r.lang, r.source] = leaf.get((r.domain, r.lang, r.source), 0) + r.n_tokens
    cap = lambda pre: sum(2 * v for k, v in leaf.items() if k[: len(pre)] == pre)
    budget = {}
    domains = fill_brute(total, {d: (10, cap((d,))) for d in {k[0] for k in leaf}})
    for d, b in domains.items():
        langs = fill_brute(b, {x: (mixing.LANG_WEIGHTS.get(x, 10), cap((d, x))) for x in {k[1] for k in leaf if k[0] == d}})
        for x, lb in langs.items():
            budget |= {(d, x, s): v for s, v in fill_brute(lb, {s: (10, cap((d, x, s))) for s in {k[2] for k in leaf if k[:2] == (d, x)}}).items()}
    want = []
    for k, b in budget.items():
        mine, left, e = [r for r in light if (r.domain, r.lang, r.source) == k], b, 0
        while left > 0:
            for r in sorted(mine, key=lambda r: (hashlib.md5(f"{mixing.SEED}:{e}:{r.name}".encode()).hexdigest(), r.doc_id or 0, r.n_tokens)):
                if left > 0:
                    want.append((*k, r.doc_id or 0, e, min(left, r.n_tokens)))
                    left -= min(left, r.n_tokens)
            e += 1
    # After its budget's last whole epoch a leaf takes nothing; documents without tokens before that count.
    got = [(r.domain, r.lang, r.source, r.doc_id or 0, r.epoch, r.take_tokens) for r in mixing.mix(docs).collect()]
    keep = lambda xs: sorted(x for x in xs if x[-1])
    assert keep(got) == keep(want)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in whole.collect()) == sorted(x[3] for x in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# quality, toxicity, licences


def labelled(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def test_quality_held_out(spark, docs, rows, none):
    documents, labels = labelled(spark, "documents"), labelled(spark, "labels")
    model = quality.learned(documents, labels)
    got = quality.score(documents, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = quality.score(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(none, model).count() == 0
    no_labels = quality.learned(documents, labels.where("false"))
    assert no_labels == (0.0, [])


def test_quality_rules_are_what_spark_computes(spark):
    documents, labels = labelled(spark, "documents"), labelled(spark, "labels")
    b, kept = quality.learned(documents, labels)
    stats, names = quality.with_statistics(documents)
    found = stats.select(*[f"__q_{n}" for n in names], quality.compiled((b, kept)).alias("score")).collect()
    x = np.array([tuple(r)[:-1] for r in found])
    margin = b + sum(w * quality.holds(rule, x, names) for w, rule in kept)
    assert np.allclose(1 / (1 + np.exp(-margin)), [r.score for r in found])
    assert 0 < len(kept) < 100 and all(len(rule) <= quality.DEPTH for _, rule in kept)


def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    r = rng.integers(0, 2, (800, 6)).astype(float)
    y = (r[:, 0] > 0.5).astype(float)
    _, w = quality.lasso(r, y, penalty=0.02)
    assert w[0] > 1 and (np.abs(w[1:]) < 0.05).all()


def test_toxicity_held_out(spark, docs, rows, none):
    documents, labels = labelled(spark, "documents"), labelled(spark, "labels")
    lexicon = toxicity.learned(documents, labels)
    got = toxicity.score(documents, lexicon).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert not [r for r in got if r.predicted and not r.toxic]
    assert toxicity.score(docs, lexicon).count() == len(rows) and toxicity.score(none, lexicon).count() == 0
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == len(rows)


@pytest.mark.parametrize(("text", "toxic"), [("you idiot", 1), ("you 1d10t there", 1), ("an іdіоt", 1), ("put it in the trash can now", 0), ("trash can and trash", 1), ("idiosyncratic text", 0), ("", 0), ("good day", 0), ("STUP!D m0ron", 1), ("in 1984 we had 10 clowns", 1)])
def test_toxicity_folding(text, toxic):
    score, _ = toxicity.score_text(text, toxicity.automaton(dict.fromkeys(toxicity.SEED_LEXICON, 3.0)))
    assert (score >= 0.5) == bool(toxic)


def test_lexicon_learns_stems_from_many_texts():
    rng = random.Random(3)
    rows_ = [(words(rng, 40) + " vexo" + rng.choice("abcdef"), 1) for _ in range(30)] + [(words(rng, 40), 0) for _ in range(200)]
    copies = [(words(random.Random(8), 40) + " uniqueword", 1)] * 50
    lexicon = toxicity.learn_lexicon(rows_ + copies)
    assert any("vexo".startswith(s) or s.startswith("vexo") for s in lexicon) and not any(s.startswith("uniq") for s in lexicon)


@pytest.mark.parametrize(
    ("text", "want"),
    [("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("# SPDX-License-Identifier: GPL-3.0\ncode", "GPL-3.0"), ("x\nReleased under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("a poetic licence to write", None), ("", None)],
)
def test_own_license(text, want):
    assert licenses.own_license(text, licenses.Templates(licenses.TEMPLATES))[0] == want


GPL_HEADER = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 *
 * int x; */"""
MIT_GRANT = "Copyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, subject to the following conditions:\n\nTHE SOFTWARE IS PROVIDED AS IS"


@pytest.mark.parametrize(("text", "want"), [(GPL_HEADER.format(2), "GPL-2.0"), (GPL_HEADER.format(3), "GPL-3.0"), (MIT_GRANT, "MIT"), ("GNU GENERAL PUBLIC LICENSE\n\nVersion", None), ("GNU GENERAL PUBLIC LICENSE, version 2", "GPL-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0")])
def test_wrapped_headers_and_versions(text, want):
    assert licenses.own_license(text, licenses.Templates(licenses.TEMPLATES), headers=licenses.Templates(licenses.HEADERS))[0] == want


def test_license_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [(1, "LICENSE", mit), (2, "a/b/c.py", "code"), (3, "a/COPYING.txt", apache), (4, "top.py", None), (5, "a/x.py", "# " + mit + "\n" + "code " * 50), (6, "a/b/d/e/f.py", ""), (7, None, mit), (8, "z/q.py", "code"), (8, "z/q.py", "code")]
    got = sorted((r.id, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(files, "id long, path string, text string")).collect())
    assert got == [(1, "MIT", None), (2, "Apache-2.0", "a"), (3, "Apache-2.0", None), (4, "MIT", ""), (5, "MIT", None), (6, "Apache-2.0", "a"), (7, "MIT", None), (8, "MIT", ""), (8, "MIT", "")]


def test_license_query_edges(docs, rows, none):
    assert licenses.scan(licenses.document_files(docs)).count() == len(rows)
    assert licenses.scan(licenses.document_files(none)).count() == 0


# queries and pipeline


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = catalog.queries()[name](spark, SF)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cursor.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "secret scan", "mixture", "packing"]
    now = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.saved(stage(spark, now, SF), "test")
        assert now.columns == documents.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    again = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert sum(x[2] for x in key(last)) == sum(x[2] for x in key(again)) > 0


def test_pipeline_stages_take_odd_rows(spark, docs, none):
    import corpus_pipeline

    for df in (docs, none):
        now = df
        for _, stage in corpus_pipeline.STAGES:
            now = common.saved(stage(spark, now, SF), "odd")
        assert now.count() == 0 if df is none else now.count() > 0
