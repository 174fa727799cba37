"""SimHash near-duplicates with BK-trees (operator 6).

A text's words (A-Z lowered, split at ASCII white space) give word shingles; a bit of its fingerprint is
1 if it is set in over half of the shingles' XXH64 hashes. BK-trees, children keyed by the integer Hamming
distance to the parent, find fingerprints within a radius by following only edges within it.

The trees are built shard by shard. A shard of *all* fingerprints could be neither broadcast nor searched at
100 TB, so shards are such that each pair of interest meets in one, and are dealt out by a shuffle:

* fingerprint_links(): all pairs within 2 bits, exactly. 64 bits are cut into 4 blocks of 16; two
  fingerprints within 2 bits agree in 2 blocks at least, so there is a shard for each 2 blocks and their bits.
* near_groups(): texts alike in at least a given share of their shingle sets (Jaccard). Fingerprints of such
  texts can differ in any number of bits, the more the shorter the texts are, so neither fingerprints nor
  trees decide here. Shards are pairs of min-hashes of the shingles. Members whose set sizes allow the
  similarity at all join one cluster, and exact Jaccard on whole shingle sets decides for each two of a
  cluster. Only pairs that share none of NEAR_SHARDS shards can be missed: (1 - J * J) ** NEAR_SHARDS.

A shard of op6 with more than BLOCK members is cut into blocks, and a tree of one block is searched with the members
of another, for each two blocks; no task holds more than two blocks. A task returns a forest of its links,
never all pairs, and the components of all forests are the groups.

A cluster of near_groups() is cut into blocks of NEAR_BLOCK members and BODY_BYTES of shingle hashes. Pairs that are
connected already need no look, so a large group of copies costs about as much as it has members: blocks are joined up
inside first; then the first members of what came out, a few a block, are compared over all blocks; last, only the members
outside a cluster's largest component meet all others.

Defined cases: null or empty text has no words, fingerprint 0 and (for near_duplicates) the empty shingle
set; all such texts are copies of each other. Texts of fewer words than a shingle are one shingle. Very long texts are
read whole, a text at a time. Ties are resolved by the smallest doc_id. A null doc_id has its own fingerprint's
component, which is null if no row of it has a doc_id; without_linked() and without_near_duplicates() never remove rows with a null doc_id. Rows that
share a doc_id are one document, alike to another if one of its texts is; of several the one with the smallest text stays.
Empty tables give empty results. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, cell, dropped, packed, quoted, saved, slices, table, texts, unpacked, values
from rankloom.llm.graph import Forest, blocked, components, cut_up, joined_on, runs

SHINGLE, RADIUS_BITS = 3, 2
NEAR_SHINGLE, NEAR_JACCARD, NEAR_SHARDS = 5, 0.8, 10
BLOCK, NEAR_BLOCK = 512, 256
#: Bytes of shingle hashes in a block of near_groups(); a longer text has a block of about its own.
BODY_BYTES = 4 << 20
_SEED = 42


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; none for a text without words."""
    words = text.encode().lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :] - 1
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[s:e], _SEED) for s, e in zip(starts[:n].tolist(), last[:n].tolist(), strict=True)), dtype=np.uint64, count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits (unsigned): those set in over half of the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Fingerprints by Hamming distance; search() follows only edges that can lead within the radius."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, dict]] = []  # (fingerprint, name, children by distance)

    def add(self, fp: int, name: int) -> None:
        new = (fp, name, {})
        if self.nodes:
            at = self.nodes[0]
            while (below := at[2].get(d := (fp ^ at[0]).bit_count())) is not None:
                at = below
            at[2][d] = new
        self.nodes.append(new)

    def search(self, fp: int, radius: int) -> list[int]:
        found, stack = [], self.nodes[:1]
        while stack:
            other, name, children = stack.pop()
            d = (fp ^ other).bit_count()
            if d <= radius:
                found.append(name)
            if children:
                stack += [c for e, c in children.items() if d - radius <= e <= d + radius]
        return found


def _tree_links(rows: list[tuple], radius: int) -> list[tuple]:
    """Forest of the links of one group of blocked(): rows end in (node, fp, s)."""
    names, fps, blocks = [r[-3] for r in rows], [r[-2] & 0xFFFFFFFFFFFFFFFF for r in rows], [r[-1] for r in rows]
    if len(rows) == 2:
        return [tuple(names)] if (fps[0] ^ fps[1]).bit_count() <= radius else []
    forest, tree, first = Forest(len(rows)), BKTree(), min(blocks)
    across = first != max(blocks)  # two blocks: one makes the tree, the other searches it
    if across:
        for x, s in enumerate(blocks):
            if s == first:
                tree.add(fps[x], x)
    for x, s in enumerate(blocks):
        if not across or s != first:
            for y in tree.search(fps[x], radius):
                forest.join(x, y)
            if not across:
                tree.add(fps[x], x)
    return forest.links(names)


def shard_links(shards: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all nodes within the radius in a shard; shards: (key, node, fp)."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in runs(batches, 3):
            rows += _tree_links(group, radius)
            if len(rows) > 4096:
                yield batch(out, list(zip(*rows, strict=True)))
                rows = []
        if rows:
            yield batch(out, list(zip(*rows, strict=True)))

    groups = blocked(shards, "key", "node", block).select("key", "i", "j", "node", "fp", "s")
    return groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(run, "a long, b long")


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts(b.column(1))], dtype=np.uint64)
            yield batch(out, [b.column(0), fps.view(np.int64)])

    arrow_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within `radius` (2 at most) bits; fps: (fp)."""
    if radius > 2:
        raise ValueError("four blocks find pairs within 2 bits")
    cuts = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    keys = [F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(cuts[a], 16)).bitwiseOR(cuts[b]) for n, (a, b) in enumerate((a, b) for a in range(4) for b in range(a))]
    return shard_links(fps.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"), "fp"), radius, block)


def groups(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS_BITS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; fingerprints link within `radius` bits."""
    fps = saved(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    links = saved(fingerprint_links(distinct.select("fp"), radius, block), "fingerprint-links")
    roots = components(links)
    dropped(links)
    # Fingerprints that link with others are few; each gets its component's smallest doc_id.
    linked = saved(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    lows = linked.groupBy("root").agg(F.min("low").alias("component"))
    found = joined_on(linked.select("fp", "root"), lows, "root").select("fp", "component")
    named = saved(distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id")), "named")
    dropped(distinct, linked, roots)
    return joined_on(fps, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def _sketches(df: DataFrame, shingle: int, shards: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, size, k0 ...): of the set of shingles, so that texts with equal sets are one content; k0 ... are its shards."""
    odd = np.random.default_rng(20240601).integers(1, 1 << 63, 2 * shards, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    names = [f"k{n}" for n in range(shards)]
    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), *((n, pa.int64()) for n in names)])

    def one(text: str) -> tuple[bytes, int, np.ndarray]:
        h = np.unique(shingle_hashes(text, shingle))
        if not len(h):
            return _digest(h), 0, np.zeros(shards, dtype=np.int64)
        with np.errstate(over="ignore"):
            mixed = h ^ (h >> np.uint64(29))
            low = np.array([(mixed * m).min() for m in odd])
            keys = (low[::2] * np.uint64(0x9E3779B97F4A7C15) ^ low[1::2]) + np.arange(shards, dtype=np.uint64)
        return _digest(h), len(h), keys.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digests, sizes, keys = zip(*map(one, texts(b.column(1))), strict=True)
            yield batch(out, [b.column(0), list(digests), list(sizes), *np.stack(keys, axis=1)])

    arrow_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, digest binary, size long, " + ", ".join(f"{n} long" for n in names))


def _meetings(contents: DataFrame, shards: int, least: float) -> DataFrame:
    """Links (a, b) that connect any two members of a shard whose sizes allow the similarity; contents: (node, size, k0 ...).

    Jaccard is at most the ratio of the sizes. Sizes are cut where they grow by 1 / least, so two that allow it
    are in one class or in neighbouring ones, and each member goes to its own class's shard and to the next one's.
    """
    level = F.floor(F.log("size") / (math.log(1 / least) + 1e-9))
    keys = [F.xxhash64(f"k{n}", level + up) for n in range(shards) for up in (0, 1)]
    members = saved(contents.where("size > 0").select("node", F.explode(F.array(*keys)).alias("key")), "members")
    heads = saved(members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("a < last").select("key", "a", "n"), "heads")
    links = saved(joined_on(members, heads.select("key", "a"), "key", counts=heads).where("a <> node").select("a", F.col("node").alias("b")), "meetings")
    dropped(members, heads)
    return links


def _jaccard_links(rows: list[tuple], least: float) -> list[tuple]:
    """Forest of the pairs of one group whose sets are alike enough; rows end in (node, set, s). Of two blocks s, pairs over both.

    A member is compared with all others at once, through an inverted index; one that is in the largest component needs no look
    of its own, as each pair has a member outside it or is connected.
    """
    names, sets, blocks = [r[-3] for r in rows], [np.frombuffer(r[-2], "<u8") for r in rows], [r[-1] for r in rows]
    m, sizes = len(rows), np.array([len(s) for s in sets], dtype=np.int64)
    up, block, across = Forest(m), np.array(blocks), len(set(blocks)) > 1
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    at = at.astype(np.int32)
    order = np.argsort(at, kind="stable")
    owners = np.repeat(np.arange(m, dtype=np.int32), sizes)[order]
    first = np.searchsorted(at[order], np.arange(at.max() + 2 if len(at) else 1))
    ends = np.cumsum(sizes)
    del order

    def compare(x: int) -> None:
        own = at[ends[x] - sizes[x] : ends[x]]
        n = first[own + 1] - first[own]
        stop = np.cumsum(n)
        if not len(stop):
            return
        shared = np.bincount(owners[np.repeat(first[own] - (stop - n), n) + np.arange(stop[-1])], minlength=m)
        alike = shared >= least * (sizes[x] + sizes - shared)
        if across:
            alike &= block != block[x]
        for y in np.flatnonzero(alike).tolist():
            up.join(x, y)

    waiting, largest, members = [], -1, 0
    for x in range(m):
        if largest >= 0 and up.root(x) == up.root(largest):
            waiting.append(x)
            continue
        compare(x)
        if (n := sum(up.root(y) == up.root(x) for y in range(m))) > max(members, 1):
            largest, members = x, n
    for x in waiting:
        if up.root(x) != up.root(largest):
            compare(x)
    return up.links(names)


def _compared(groups: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Links (a, b) of the groups of equal keys; groups: (*keys, node, body, block)."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, len(keys)):
            if found := _jaccard_links(group, least):
                yield batch(out, list(zip(*found, strict=True)))

    arrow_batches(groups.sparkSession)
    return groups.select(*keys, "node", "body", "block").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def _cluster_links(bodies: DataFrame, least: float, near_block: int) -> DataFrame:
    """Links (a, b) that connect the alike ones of each cluster, saved; bodies: (cluster, node, size, body, s, n_blocks), saved."""
    inside = saved(_compared(bodies.withColumn("block", F.lit(0)), ["cluster", "s"], least), "links-inside")
    wide = bodies.where("n_blocks > 1")
    if not wide.limit(1).count():
        return inside
    # The first members of the components of blocks meet over all blocks.
    light = saved(wide.select("cluster", "node", "s", "n_blocks"), "wide")
    roots = components(inside)
    heads = light.join(roots, "node", "left").where(F.coalesce("root", "node") == F.col("node")).select("cluster", "node")
    met = blocked(saved(wide.drop("s", "n_blocks").join(heads, ["cluster", "node"], "left_semi"), "heads"), "cluster", "node", near_block, "size", BODY_BYTES // 8)
    over = saved(_compared(met.withColumnRenamed("s", "block"), ["cluster", "i", "j"], least), "links-over")
    dropped(roots)
    # Who isn't in the largest component of the cluster meets all of it.
    roots = components(inside.unionByName(over))
    named = saved(light.join(roots, "node", "left").select("cluster", "node", F.coalesce("root", "node").alias("root")), "named")
    counts = named.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("cluster", F.col("most.root").alias("main"))
    strays = saved(joined_on(named, most, "cluster").where("root <> main").select("cluster", "node"), "strays")
    dropped(roots, named)
    if not strays.limit(1).count():
        return inside.unionByName(over)
    rows = saved(wide.join(strays, ["cluster", "node"], "left_semi"), "stray-bodies")
    sums = rows.groupBy("cluster").agg((F.sum("size") * 8 / BODY_BYTES).alias("by_size"), (F.count(F.lit(1)) / near_block).alias("by_count"))
    sized = saved(sums.select("cluster", F.ceil(F.greatest("by_size", "by_count")).cast("int").alias("n_stray")), "stray-blocks")
    members = joined_on(wide, sized, "cluster").select("cluster", "node", "body", F.lit(0).alias("block"), "s", F.explode(F.sequence(F.lit(0), F.col("n_stray") - 1)).alias("u"))
    u = F.pmod(F.xxhash64(F.lit(8), "node"), F.col("n_stray")).cast("int")
    guests = joined_on(rows, sized, "cluster").select("cluster", "node", "body", F.lit(1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("s"), u.alias("u"))
    last = saved(_compared(members.unionByName(guests), ["cluster", "s", "u"], least), "links-strays")
    return inside.unionByName(over).unionByName(last)


def near_groups(df: DataFrame, shingle: int = NEAR_SHINGLE, least: float = NEAR_JACCARD, shards: int = NEAR_SHARDS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, near_block: int = NEAR_BLOCK) -> DataFrame:
    """(doc_id, component_id) of each document that isn't the first of its group of alike texts.

    near_block bounds the groups of the exact comparison; block (of a tree's group) has no part in it, and is taken as groups() takes it.
    """
    known = df.where(df[id_col].isNotNull())
    sketches = saved(_sketches(known, shingle, shards, id_col, text_col), "sketches")
    names = [f"k{n}" for n in range(shards)]
    contents = saved(sketches.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in ("size", *names)]), "contents")
    tried = components(meetings := _meetings(contents, shards, least))
    dropped(meetings)
    # Only contents that share a shard with another are read again, and checked on whole shingle sets.
    candidates = contents.select("node", "digest", "size").join(tried.withColumnRenamed("root", "cluster"), "node")
    candidates = saved(cut_up(saved(candidates, "candidates"), "cluster", "node", near_block, "size", BODY_BYTES // 8), "cut")
    texts_of = known.select(known[id_col].cast("long").alias("node"), known[text_col].alias("text")).join(candidates, "node")
    fields = [("cluster", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("body", pa.binary()), ("s", pa.int32()), ("n_blocks", pa.int32())]
    out = pa.schema(fields)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts(b.column(0))]
            # A document with several texts has a row for each two of its texts and contents: one of them belongs together.
            same = pa.array([_digest(h) == d for h, d in zip(sets, values(b.column(1)), strict=True)], type=pa.bool_())
            rows = batch(out, [*b.columns[2:5], [h.astype("<u8").tobytes() for h in sets], *b.columns[5:]])
            yield rows.filter(same)

    arrow_batches(df.sparkSession)
    bodies = texts_of.select("text", "digest", "cluster", "node", "size", "s", "n_blocks").mapInArrow(hashed, "cluster long, node long, size long, body binary, s int, n_blocks int")
    if sketches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        bodies = bodies.dropDuplicates(["cluster", "node", "body"])  # repeated rows
    bodies = saved(bodies, "bodies")
    roots = components(_cluster_links(bodies, least, near_block))
    dropped(tried, candidates, bodies)
    placed = saved(contents.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id")), "placed")
    dropped(contents, roots)
    return joined_on(sketches.select("doc_id", "digest"), placed, "digest").where("doc_id <> component_id").select("doc_id", "component_id")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one document (the smallest doc_id) of each group of texts alike by Jaccard; all columns kept."""
    return _without(df, near_groups(df, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def without_linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one document (the smallest doc_id) of each component of groups(): fingerprints that BK-trees link; all columns kept."""
    found = groups(df.where(df[quoted(id_col)].isNotNull()), id_col=id_col, text_col=text_col, **options)
    return _without(df, found.where("doc_id <> component_id"), id_col, text_col)


def _without(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df without the documents found (doc_id); of rows that share a doc_id one is kept."""
    extra = saved(found.select(F.col("doc_id").alias("doc")).distinct(), "extra")
    rows = packed(df, doc=df[quoted(id_col)].cast("long"))
    kept = rows.join(extra, "doc", "left_anti")
    again = saved(rows.where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").select("doc"), "repeated")
    if not again.limit(1).count():
        return unpacked(kept, df.columns)
    # Rows that share a doc_id: the one with the smallest text, and of equal ones the first.
    single = kept.join(again, "doc", "left_anti").select("row")
    least = F.min_by("row", F.struct(cell(text_col).alias("text"), F.to_json("row").alias("whole")))
    many = kept.join(again, "doc", "left_semi").groupBy("doc").agg(least.alias("row")).select("row")
    return unpacked(single.unionByName(many), df.columns)


def op6_simhash(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"))
