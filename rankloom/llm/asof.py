"""Point-in-time join of questions with versions by a reverse sparse table (operator 13).

A version of a key holds from `start` (included) to `stop` (excluded), whole numbers; a question names a key and a time t.
Of the versions that hold at t the one with the greatest order columns wins. A sparse table is filled backwards: an
interval is covered with two overlapping blocks of a power of two, NumPy's maximum.at puts the version's rank there,
each level's winners are pushed down to the level below, and the lowest level is indexed by the questions' times.

Time is cut so that no table grows with the data: a node is a run of 2 ** BITS units of a tier, a tier's unit is a
node of the tier below, and an interval lies in two nodes a tier at most (its ragged ends below, its whole units above).
A cell (key, tier, node, level, place) keeps its best version only, combined on the map side, so a node has
at most (BITS + 1) * 2 ** BITS rows, however many versions a hot key has. Tiers are worked from the top: the winner of a unit
that is asked for is pushed down as the cell that fills the unit's node in the tier below. Units are asked for once each, at the
lowest tier as (key, t). Nodes are dealt out by a shuffle; a task works on many nodes at once and holds GROUP_ROWS of rows.
Nothing is broadcast or collected but one number, the longest interval, which sets the number of tiers.

Defined cases: a null key, start, stop or t matches nothing (the question stays, its winner is null); start >= stop holds nowhere;
a null order column is the least;
ties in all order columns go to the greater hash of the payload; repeated versions are one, repeated questions stay rows of their own;
empty tables give no winners or no rows; any further columns of questions stay, of versions only those named are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, released, saved, table
from rankloom.llm.graph import joined_on

#: A node has 2 ** BITS units.
BITS = 8
#: Rows of nodes that a task works on at once; a node has fewer.
GROUP_ROWS = 1 << 17
_CELL, _ASK = 0, 1
_LEAST = -(1 << 63)


def point_in_time(asks: DataFrame, versions: DataFrame, key: str, t: str, start: Column, stop: Column, order: list[Column], payload: list[str], bits: int = BITS) -> DataFrame:
    """asks with a struct `winner` of the version's order columns (o0, o1, ... , long) and payload columns, null without one.

    asks: has the columns named key and t (long). versions: has a column named key. order: long columns, most important first.
    """
    names = [f"o{i}" for i in range(len(order))] + ["tie"]
    best = F.struct(*[o.cast("long").alias(n) for o, n in zip(order, names, strict=False)], F.xxhash64(*payload).alias("tie"), *payload)
    held = versions.select(F.col(key).alias("key"), start.cast("long").alias("a"), stop.cast("long").alias("z"), best.alias("v")).where("key IS NOT NULL AND a < z")
    longest = held.agg(F.max(F.col("z") - F.col("a"))).first()[0] or 1
    tiers = max(int(longest).bit_length() - 1, 0) // bits + 1
    wanted = asks.select(F.col(key).alias("key"), F.col(t).cast("long").alias("t")).where("key IS NOT NULL AND t IS NOT NULL").distinct()
    cells = _cells(held, tiers, bits)
    cells = saved(cells, "cells") if tiers > 1 else cells
    for k in reversed(range(tiers)):
        mine = cells.where(F.col("tier") == k).drop("tier")
        if k < tiers - 1:
            mine = mine.unionByName(found.select("key", F.col("t").alias("node"), F.lit(bits).alias("level"), F.lit(0).alias("place"), F.col("winner").alias("v")))
        units = wanted if k == 0 else wanted.select("key", F.shiftright("t", bits * k).alias("t")).distinct()
        found = _winners(mine, units, names, bits)
    known = saved(found, "winners").select(F.col("key").alias(key), F.col("t").alias(t), "winner")  # so that a hot time of a key can be split in the join
    return asks.join(known, [key, t], "left")


def _cells(held: DataFrame, tiers: int, bits: int) -> DataFrame:
    """(key, tier, node, level, place, v): the best version of each cell that an interval's blocks take."""
    a, z, runs = F.col("a"), F.col("z"), []
    alive = F.lit(True)
    for k in range(tiers):
        up_a, up_z = F.shiftright(a + ((1 << bits) - 1), bits), F.shiftright(z, bits)  # the first whole unit above, and the end of the last
        low_a, low_z = F.shiftleft(up_a, bits), F.shiftleft(up_z, bits)
        within = up_a > up_z  # inside one node, and touching neither of its ends
        for one, x, y in ((within, a, z), (~within & (a < low_a), a, low_a), (~within & (low_z < z), low_z, z)):
            runs.append(F.when(alive & one, F.struct(F.lit(k).alias("tier"), F.shiftright(x, bits).alias("node"), x.alias("x"), (y - x).cast("int").alias("n"))))
        alive = alive & ~within & (up_a < up_z)
        a, z = up_a, up_z
    run = held.select("key", "v", F.explode(F.filter(F.array(*runs), lambda r: r.isNotNull())).alias("r"))
    level = F.length(F.bin("r.n")) - 1
    places = F.array_distinct(F.array(F.col("r.x"), F.col("r.x") + F.col("r.n") - F.call_function("shiftleft", F.lit(1), level)))
    cells = run.select("key", "r.tier", "r.node", level.alias("level"), F.explode(places).alias("at"), "v")
    return cells.groupBy("key", "tier", "node", "level", F.col("at").bitwiseAND((1 << bits) - 1).cast("int").alias("place")).agg(F.max("v").alias("v"))


def _winners(cells: DataFrame, units: DataFrame, names: list[str], bits: int) -> DataFrame:
    """(key, t, winner) of the units (key, t) of a tier that have one; cells: (key, node, level, place, v)."""
    v = cells.schema["v"].dataType
    left = cells.select("key", "node", F.lit(_CELL).alias("kind"), "level", "place", F.lit(0).cast("long").alias("t"), "v.*")
    place = F.col("t").bitwiseAND((1 << bits) - 1).cast("int")
    right = units.select("key", F.shiftright("t", bits).alias("node"), F.lit(_ASK).alias("kind"), F.lit(0).alias("level"), place.alias("place"), "t", *[F.lit(None).cast(f.dataType).alias(f.name) for f in v.fields])
    nodes = left.unionByName(right).repartition("key", "node").sortWithinPartitions("key", "node", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_nodes(batches):
            yield from _indexed(whole, names, bits).to_batches()
        released()

    arrow_batches(cells.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [units.schema["key"], units.schema["t"], *v.fields])
    return nodes.mapInArrow(run, fields).select("key", "t", F.struct(*[f"`{f.name}`" for f in v.fields]).alias("winner"))


def _changes(rows: pa.Table) -> np.ndarray:
    """Whether each row begins a node."""
    key = rows["key"].combine_chunks()
    key = key.dictionary_encode() if not isinstance(key, pa.DictionaryArray) else key
    parts = (key.indices.to_numpy(zero_copy_only=False), rows["node"].to_numpy())
    begins = np.ones(rows.num_rows, dtype=bool)
    begins[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
    return begins


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of GROUP_ROWS rows or so of sorted batches, none of which ends within a node."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= GROUP_ROWS:
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(rows))[-1])
            if last:
                yield rows.slice(0, last)
            held = rows.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _indexed(rows: pa.Table, names: list[str], bits: int) -> pa.Table:
    """(key, t, the version's columns) of the questions among the rows of whole nodes that some version answers."""
    width = 1 << bits
    out = rows.select([c for c in rows.column_names if c not in ("node", "kind", "level", "place")])
    kind, node = rows["kind"].to_numpy(), np.cumsum(_changes(rows)) - 1
    cells, asked = np.flatnonzero(kind == _CELL), np.flatnonzero(kind == _ASK)
    if not len(cells) or not len(asked):
        return out.slice(0, 0)
    # Ranks of versions over all nodes at hand: the greatest wins.
    ranks = np.empty(len(cells), dtype=np.int64)
    by = np.lexsort([rows[n].combine_chunks().take(pa.array(cells)).fill_null(_LEAST).to_numpy() for n in reversed(names)])
    ranks[by] = np.arange(len(cells))
    # Only nodes with questions need a table.
    wanted, which = np.unique(node[asked], return_inverse=True)
    slot = np.full(int(node[-1]) + 1, -1)
    slot[wanted] = np.arange(len(wanted))
    mine = slot[node[cells]]
    use = mine >= 0
    best = np.full((bits + 1, len(wanted), width), -1, dtype=np.int64)
    np.maximum.at(best, (rows["level"].to_numpy()[cells][use], mine[use], rows["place"].to_numpy()[cells][use]), ranks[use])
    for level in range(bits, 0, -1):
        half = 1 << (level - 1)
        np.maximum(best[level - 1], best[level], out=best[level - 1])
        np.maximum(best[level - 1][:, half:], best[level][:, :-half], out=best[level - 1][:, half:])
    rank = best[0][which, rows["place"].to_numpy()[asked]]
    hit = rank >= 0
    won = out.take(pa.array(cells[by[rank[hit]]]))
    asks = asked[hit]
    return won.set_column(won.column_names.index("t"), "t", rows["t"].take(pa.array(asks))).set_column(0, out.schema.field("key"), pc.take(rows["key"], pa.array(asks)))


def _drawn(n: int) -> Column:
    """The n-th eight-digit group of the hex sha256 of decimal doc_id, as a number."""
    return F.conv(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 8 * n + 1, 8), 16, 10).cast("long")


def op13_point_in_time(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    event = _drawn(0) % 50000
    arrival, expiry = event - 60 + _drawn(1) % 600, event + _drawn(2) % 900
    labels = table(spark, sf_dir, "labels").select("doc_id", (_drawn(3) % 50000).alias("t"))
    sources = docs.where("doc_id IS NOT NULL AND source IS NOT NULL").groupBy("doc_id").agg(F.min("source").alias("source"))
    known = labels.where("doc_id IS NOT NULL")
    asks = joined_on(known, sources, "doc_id", "left").select("doc_id", "t", "source")
    asks = asks.unionByName(labels.where("doc_id IS NULL").withColumn("source", F.lit(None).cast("string")))
    found = point_in_time(asks, docs.select("source", event.alias("event"), arrival.alias("arrival"), expiry.alias("expiry"), "doc_id", "n_chars", "lang"), "source", "t",
                          F.greatest("event", "arrival"), F.col("expiry"), [F.col("event"), -F.col("arrival"), F.col("doc_id")], ["n_chars", "lang"])
    age = F.col("t") - F.col("winner.o0")
    rows = found.select("doc_id", "t", F.col("winner.o2").alias("version_id"), age.alias("age"), F.when(age.isNull(), "none").when(age > 120, "stale").otherwise("fresh").alias("status"), "winner")
    fresh = F.col("status") == "fresh"
    return rows.select("doc_id", "t", "version_id", "age", "status", F.when(fresh, F.col("winner.n_chars")).alias("n_chars"), F.when(fresh, F.col("winner.lang")).alias("lang"))


ORACLE_SQL = """
WITH d AS (SELECT *, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS a, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 9, 8))::BIGINT AS b,
  ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 17, 8))::BIGINT AS c FROM documents),
v AS (SELECT doc_id AS id, source, n_chars, lang, a % 50000 AS event, a % 50000 - 60 + b % 600 AS arrival, a % 50000 + c % 900 AS expiry FROM d WHERE source IS NOT NULL),
q AS (SELECT l.doc_id, ('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 25, 8))::BIGINT % 50000 AS t, s.source, row_number() OVER () AS n
  FROM labels l LEFT JOIN documents s ON s.doc_id = l.doc_id),
hits AS (SELECT q.n, v.*, row_number() OVER (PARTITION BY q.n ORDER BY event DESC, arrival, id DESC) AS k FROM q JOIN v ON v.source = q.source AND event <= t AND arrival <= t AND t < expiry)
SELECT q.doc_id, q.t, id AS version_id, q.t - event AS age, CASE WHEN event IS NULL THEN 'none' WHEN q.t - event > 120 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN q.t - event <= 120 THEN h.n_chars END AS n_chars, CASE WHEN q.t - event <= 120 THEN h.lang END AS lang
FROM q LEFT JOIN hits h ON h.n = q.n AND k = 1
"""
