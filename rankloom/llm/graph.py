"""Connected components of link tables, joins on hot keys, and streams of sorted groups.

Components: links are contracted first, each task's own by union-find (in bounded runs of links). What is left goes
through label propagation with hooking and pointer jumping. Every step is a join and a grouped minimum (combined on
the map side), written to the shared folder, so nothing is collected and a lost executor costs one step.

A node with very many links makes no hot task: minima are pre-aggregated, and joins on it go by joined_on().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, dropped, saved, values

#: Hooking and jumping settle after a number of steps near the logarithm of the longest path.
MAX_STEPS = 100
#: Links that a task contracts at once.
LINKS = 200_000
#: A key with more than this share of the rows is hot; so there are at most 512 of them.
HOT_SHARE = 1 / 512
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def joined_on(rows: DataFrame, named: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with named, which has one row for each key at most; how: inner or left.

    Rows of hot keys meet their (at most 1 / HOT_SHARE) rows of named by broadcast, where they lie. rows is read twice.
    counts: (key, n) of rows, if known.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    least = rows.count() * HOT_SHARE
    hot = [r[0] for r in counts.select(key, "n").where((F.col("n") > max(least, 64)) & F.col(key).isNotNull()).collect()]
    if not hot:
        return rows.join(named, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(named.where(is_hot)), key, how).unionByName(rows.where(~is_hot).join(named, key, how))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) links that connect what the links (a, b) connect; root is the smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, higher := up[up]):
            up = higher
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    below = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[up[below]], nodes[below]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that connect the same nodes: a forest of each task's links, or of each LINKS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            found = forest(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            held.clear()
            return batch(_LINK, list(found))

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= LINKS:
                yield out()
        if held:
            yield out()

    arrow_batches(links.sparkSession)
    return links.select("a", "b").where("a <> b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node of its component."""
    links = contracted(links)
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root"), F.lit(True).alias("moved")), "roots")
    for _ in range(MAX_STEPS):
        was = labels.select("node", F.col("root").alias("old"))
        near = joined_on(both, was.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("old").alias("root"))
        best = saved(was.join(near, "node").select("node", "old", F.least("old", "root").alias("root")), "best")
        # A root also takes the smallest label that one of its members has met; then each node takes its root's root.
        hooks = best.where("root < old").groupBy(F.col("old").alias("node")).agg(F.min("root").alias("hook"))
        step = saved(best.join(hooks, "node", "left").select("node", "old", F.least("root", F.coalesce("hook", "root")).alias("root")), "step")
        above = step.select(F.col("node").alias("root"), F.col("root").alias("up")).where("up < root")
        root = F.least("root", F.coalesce("up", "root"))
        new = saved(joined_on(step, above, "root", "left").select("node", root.alias("root"), (root < F.col("old")).alias("moved")), "roots")
        dropped(labels, best, step)
        labels = new
        if not labels.where("moved").limit(1).count():
            dropped(both)
            final = labels.select("node", "root")
            final.scratch_path = labels.scratch_path
            return final
    raise RuntimeError("components did not settle")


class Forest:
    """Union-find over 0..n-1; the smaller index of two roots stays root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def links(self, names: list) -> list[tuple]:
        """(name of the root, name) of each index that isn't its own root."""
        return [(names[r], names[x]) for x in range(len(self.up)) if (r := self.root(x)) != x]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first `keys` columns, of batches sorted by these; groups may go over batches."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(values(c) for c in b.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def blocked(df: DataFrame, key: str, node: str, block: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """df's rows of keys that have several rows, dealt into bounded groups (key, i, j) with columns i <= j and s.

    A key of more than `block` rows, or more than `most` of a weight (if given), is cut by hash into blocks s; each pair
    of blocks is a group, so any two rows of a key meet in one, and no group grows beyond two blocks (evenly cut ones).
    """
    cut = cut_up(df, key, node, block, weight, most)
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return cut.withColumn("t", other).withColumns({"i": F.least("s", "t"), "j": F.greatest("s", "t")}).drop("t", "n_blocks")


def cut_up(df: DataFrame, key: str, node: str, block: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """df's rows of keys that have several rows, with their block s of the key's n_blocks."""
    sums = [F.sum(weight).alias("n_weight")] if weight else []
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *sums).where("n_rows > 1")
    parts = F.col("n_rows") / block
    n_blocks = F.ceil(F.greatest(parts, F.col("n_weight") / most) if weight else parts).cast("int")
    sized = counts.select(key, n_blocks.alias("n_blocks"))
    return joined_on(df, sized, key).withColumn("s", F.pmod(F.xxhash64(F.lit(7), F.col(node)), F.col("n_blocks")).cast("int"))
