"""Embedding near-duplicates by spherical k-means cells and blocked cosine products (operator 2).

Equal vectors are one point with a weight first. Centres come from spherical k-means on a bounded sample;
each point belongs to the cell of its nearest centre. Cells alone would lose pairs over a border, so a
point also visits each cell of higher number that a partner could belong to: a vector with cosine >= t
lies within chord c = sqrt(2 - 2 t), and if its nearest centre is k then dot(y, m_j - m_k) <= 0 for every
centre j, so dot(x, m_j - m_k) <= c |m_j - m_k| for every j. Points that break one of these bounds can't
have a partner in cell k. Every pair within t therefore meets in exactly one cell: none is lost,
whatever the data. How many visits that takes depends on the data: few where vectors form clusters,
nearly all cells for isotropic noise of low dimension.

A cell is cut into blocks of members and blocks of visitors by count, so a task holds two bounded
blocks and multiplies them in double precision. Tasks return counts and a spanning forest, not pairs.
Vectors travel as such to their cells alone; points are told apart, and joined back, by a digest of 128 bits.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing,
also not with equal ones; vectors of different length never link (very long ones are compared like any other, in smaller batches); lengths other than the most frequent
one in the sample have a cell of their own, cut into blocks; repeated vec_ids are rows of their own;
a null vec_id counts as a partner, and its component is the smallest vec_id that is not null. An
empty table gives no rows. Other columns are ignored, whatever their names; ties don't arise, as links are a threshold's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, dropped, saved, slices, table
from rankloom.llm.graph import Forest, components, joined_on

THRESHOLD = 0.95
#: Vectors from which centres are learned, at most; every vector gets a cell and is compared.
SAMPLE = 20_000
#: Points a cell, aimed at; centres at most (they are broadcast: 4,096 x 1,024 doubles are 32 MB).
CELL, MAX_CELLS = 2048, 4096
BLOCK = 4096
#: Products this near the threshold are computed again, exactly rounded.
_NEAR = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k (at most) unit centres of unit rows x; a cell that runs empty keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds if len(centres) > 1 else 1):
        cell = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-300), centres)
    return np.unique(np.round(centres, 12), axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cell of each unit row, and the cells of higher number that its partners could belong to."""
    dots = x @ centres.T
    home = np.argmax(dots, axis=1)
    k = len(centres)
    if k == 1:
        return home, [np.empty(0, dtype=np.int64)] * len(x)
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    # [cell, other centre]; the slack is for rounding in dots, also where two centres nearly coincide
    reach = chord * np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T))) + 1e-9
    visits = []
    for row, h in zip(dots, home, strict=True):
        later = np.arange(h + 1, k)
        later = later[row[h] - row[later] <= reach[later, h]]
        if len(later):
            later = later[((row[None, :] - row[later, None]) <= reach[later]).all(axis=1)]
        visits.append(later)
    return home, visits


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    dot = math.fsum((a * b).tolist())
    return dot / math.sqrt(math.fsum((a * a).tolist())) / math.sqrt(math.fsum((b * b).tolist()))


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows with cosine >= threshold; upper: a is b, each pair once."""
    ua, ub = unit(a), unit(b)
    found_i, found_j = [], []
    for at in range(0, len(a), 1024):
        products = ua[at : at + 1024] @ ub.T
        i, j = np.nonzero(products >= threshold - _NEAR)
        near = np.abs(products[i, j] - threshold) <= _NEAR
        i = i + at
        keep = np.ones(len(i), dtype=bool)
        if upper:
            keep &= i < j
        for n in np.flatnonzero(near & keep):
            keep[n] = _exact(a[i[n]], b[j[n]]) >= threshold
        found_i.append(i[keep])
        found_j.append(j[keep])
    return np.concatenate(found_i or [np.empty(0, int)]), np.concatenate(found_j or [np.empty(0, int)])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix of doubles."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1)


def _compare(group: pa.Table, threshold: float) -> list[tuple]:
    """(point, weight of partners, root of its tree) of points with partners in one task's group."""
    point, weight = group["point"].to_pylist(), np.array(group["weight"].to_pylist(), dtype=np.int64)
    role = np.array(group["visitor"].to_pylist(), dtype=bool)
    x = _matrix(group["vector"].combine_chunks())
    members, visitors = np.flatnonzero(~role), np.flatnonzero(role)
    forest, partners = Forest(len(point)), np.zeros(len(point), dtype=np.int64)
    tasks = [(members, visitors, False)] if len(visitors) and len(members) else []
    if group["first"][0].as_py():
        tasks.append((members, members, True))
    for a, b, upper in tasks:
        for at in range(0, len(a), 4096):
            # A slice of a block with itself meets itself and what follows, so that i < j holds for the block's rows too.
            part, rest = a[at : at + 4096], b[at:] if upper else b
            i, j = close_pairs(x[part], x[rest], threshold, upper)
            i, j = part[i], rest[j]
            np.add.at(partners, i, weight[j])
            np.add.at(partners, j, weight[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(p, q)
    return [(point[n], int(partners[n]), point[forest.root(n)]) for n in np.flatnonzero(partners).tolist()]


def _scaled(v: Column) -> Column:
    """Vectors of very large or small components times a power of two, so that their norm is a number; others as they are."""
    v = v.cast("array<double>")
    most = F.array_max(F.transform(v, F.abs))
    power = F.pow(F.lit(2.0), F.greatest(F.least(-F.floor(F.log2(most)), F.lit(1000)), F.lit(-1000)))
    return F.when(most.between(1e-100, 1e100), v).otherwise(F.transform(v, lambda e: e * power))


def points(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(digest, vector, low, weight): distinct usable vectors by their digest, with their smallest id and number.

    The digest has 128 bits, so that vectors themselves are keys of no shuffle. df's rows are not changed; see digest_of().
    """
    named = df.select(F.col(id_col).alias("id"), _scaled(F.col(vec_col)).alias("vector"), digest_of(F.col(vec_col)).alias("digest")).where("digest IS NOT NULL")
    return named.groupBy("digest").agg(F.first("vector").alias("vector"), F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"))


def digest_of(v: Column) -> Column:
    """128 bits of a vector's components, null for one that links with nothing."""
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    exact = v.cast("array<double>")
    return F.when(F.coalesce(usable, F.lit(False)), F.concat_ws("-", F.hex(F.xxhash64(exact)), F.hex(F.xxhash64(F.lit(17), exact)), F.size(v).cast("string")))


def linked(distinct: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """(point, partners, root) rows, several a point, of points with partners; distinct: (point, vector, weight)."""
    spark = distinct.sparkSession
    total = distinct.count()
    share = min(1.0, 1.2 * SAMPLE / max(total, 1))
    sample = [r.vector for r in distinct.select("vector").where(F.pmod(F.xxhash64(F.lit(3), "vector"), 1_000_000) < int(share * 1_000_000)).limit(SAMPLE).collect()]
    dim = Counter(map(len, sample)).most_common(1)[0][0] if sample else 0
    known = unit(np.array([v for v in sample if len(v) == dim], dtype=np.float64)) if dim else np.empty((0, 0))
    centres = spherical_kmeans(known, max(1, min(MAX_CELLS, total // cell))) if dim else known
    shared = spark.sparkContext.broadcast((dim, centres))
    out = pa.schema([("cell", pa.int64()), ("visitor", pa.bool_()), ("point", pa.int64()), ("weight", pa.int64()), ("vector", pa.list_(pa.float64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, centres = shared.value
        for b in slices(batches, rows=512):
            vectors = b.column("vector")
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            usual = np.flatnonzero(sizes == dim)
            rows = [(-int(sizes[n]), False, n) for n in np.flatnonzero(sizes != dim).tolist()]
            if len(usual):
                home, visits = cells_of(unit(_matrix(vectors.take(pa.array(usual)))), centres, threshold)
                for n, h, later in zip(usual.tolist(), home.tolist(), visits, strict=True):
                    rows.append((h, False, n))
                    rows += [(c, True, n) for c in later.tolist()]
            for at in range(0, len(rows), 8192):  # bounded, however many cells a vector visits
                part = rows[at : at + 8192]
                take = pa.array([n for *_, n in part], type=pa.int64())
                yield batch(out, [[c for c, *_ in part], [v for _, v, _ in part], b.column("point").take(take), b.column("weight").take(take), vectors.take(take)])

    arrow_batches(spark)
    placed = saved(distinct.select("point", "weight", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(place, "cell long, visitor boolean, point long, weight long, vector array<double>"), "cells")
    # Blocks: members of a cell into nm, visitors into nv. Member blocks are visitors of later member blocks.
    sizes = placed.groupBy("cell").agg(F.count_if(~F.col("visitor")).alias("members"), F.count_if("visitor").alias("guests"))
    sizes = sizes.select("cell", F.ceil(F.greatest(F.col("members"), F.lit(1)) / block).cast("int").alias("nm"), F.greatest(F.ceil(F.col("guests") / block), F.lit(1)).cast("int").alias("nv"))
    dealt = placed.join(F.broadcast(sizes), "cell")  # a row a cell: MAX_CELLS and the odd lengths, at most
    salt = F.pmod(F.xxhash64(F.lit(11), "point"), F.when(F.col("visitor"), F.col("nv")).otherwise(F.col("nm"))).cast("int")
    dealt = dealt.withColumn("s", salt)
    member = F.array_union(
        # as member: its block m = s, for each guest block g; as guest: each later member block m, in a guest block g = -1 - s
        F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda g: F.struct(F.col("s").alias("m"), g.alias("g"), F.lit(False).alias("guest"))),
        F.flatten(F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda m: F.when(m == F.col("s"), F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda t: F.struct(m.alias("m"), (-1 - t).alias("g"), F.lit(False).alias("guest")))).when(m > F.col("s"), F.array(F.struct(m.alias("m"), (-1 - F.col("s")).alias("g"), F.lit(True).alias("guest")))).otherwise(F.array().cast("array<struct<m:int,g:int,guest:boolean>>")))),
    )
    guest = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda m: F.struct(m.alias("m"), F.col("s").alias("g"), F.lit(True).alias("guest")))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("visitor"), guest).otherwise(member)))
    # A member block waits for guests of earlier blocks only (g = -1 - t, t < m).
    dealt = dealt.where((F.col("at.g") >= 0) | F.col("at.guest") | (-1 - F.col("at.g") < F.col("at.m")))
    groups = dealt.select("cell", F.col("at.m").alias("m"), F.col("at.g").alias("g"), F.col("at.guest").alias("visitor"), (F.col("at.g") == 0).alias("first"), "point", "weight", "vector")

    result = pa.schema([("point", pa.int64()), ("partners", pa.int64()), ("root", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        found = _compare(group, threshold)
        return pa.Table.from_batches([batch(result, list(zip(*found, strict=True)) if found else [[]] * 3)])

    found = saved(groups.groupBy("cell", "m", "g").applyInArrow(compare, "point long, partners long, root long"), "near")
    dropped(placed)
    return found


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; kept: the one representative of its component."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    # A point is named by a number of its own, since ids can be null or repeat.
    distinct = saved(points(rows, "vec_id", "vector").withColumn("point", F.monotonically_increasing_id()), "points")
    found = linked(distinct, threshold, block, cell)
    partners = found.groupBy("point").agg(F.sum("partners").alias("partners"))
    roots = components(found.select(F.col("root").alias("a"), F.col("point").alias("b")))
    lows = roots.join(distinct.select(F.col("point").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("component"))
    extra = partners.join(roots.withColumnRenamed("node", "point"), "point").join(lows, "root").select("point", "partners", "component")
    named = distinct.join(extra, "point", "left").select("digest", (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    known = rows.select("vec_id", digest_of(F.col("vector")).alias("digest"))
    alone = known.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = joined_on(known.where("digest IS NOT NULL"), named, "digest").select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).unionByName(alone)
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
