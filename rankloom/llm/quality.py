"""Quality by a sparse rule ensemble compiled into Spark columns (operator 8).

Statistics of a text are Spark expressions. On a bounded sample of labelled rows, small boosted trees are
grown over the statistics; each path from a root to a node is a conjunctive rule. A logistic model with
lasso weights over the rules keeps a few of them, and these become one Spark column expression, so scoring
runs in the JVM, whole texts, without Python.

Defined cases: null text counts as empty, and an empty text has all statistics 0 and the score that the
rules give to these; with no labelled rows, or one label only, the score is the share of label 1 (0.5
without rows); very long texts are scored whole; repeated rows score alike, and an empty table gives no rows; ties between splits go to the first statistic and the smaller threshold; a null doc_id is
not held out; other columns pass through with_statistics(), and are ignored by score().
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cell, packed, quoted, table
from rankloom.llm.toxicity import labelled_sample

HELD_OUT_MOD, HELD_OUT = 4, 2
#: Labelled rows used for learning, at most; chosen by hash of doc_id.
LEARN_ROWS = 20_000
TREES, DEPTH, SHRINK, BINS, MIN_LEAF = 24, 3, 0.3, 32, 20
PENALTY, STEPS = 0.002, 400
THRESHOLD = 0.7

#: A rule: conditions (statistic, "<=" or ">", threshold).
Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text column; each is 0 for an empty text. Needs the columns __text and __words for reuse."""
    n = F.greatest(F.length("__text"), F.lit(1)).cast("double")
    w = F.size("__words")
    words = F.greatest(w, F.lit(1)).cast("double")
    letters = F.regexp_count("__text", F.lit(r"\p{L}")).cast("double")
    lines = F.split("__text", "\n")
    apart = F.zip_with(F.slice("__words", 1, F.greatest(w - 1, F.lit(0))), F.slice("__words", 2, F.greatest(w - 1, F.lit(0))), lambda a, b: a == b)
    return {
        "words": w.cast("double"),
        "mean_word": F.length("__text") / words,
        "letters": letters / n,
        "upper": F.regexp_count("__text", F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1.0)),
        "digits": F.regexp_count("__text", F.lit("[0-9]")) / n,
        "marks": F.regexp_count("__text", F.lit(r"[!#$%&*?@^~=+<>{}\[\]\\_`]")) / words,
        "bars": F.regexp_count("__text", F.lit(r"[|\t;]")) / words,
        "stops": F.regexp_count("__text", F.lit(r"[.]")) / words,
        "distinct": F.size(F.array_distinct("__words")) / words,
        "echo": F.size(F.filter(apart, lambda same: same)) / words,
        "line_repeats": 1.0 - F.size(F.array_distinct(lines)) / F.size(lines),
    }


def with_statistics(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """df with its statistics as columns __q_<name> (a caller's column of such a name is replaced), and their names."""
    rows = packed(df, __text=F.coalesce(df[quoted(text_col)], F.lit("")))
    rows = rows.withColumn("__words", F.filter(F.split("__text", r"\s+"), lambda x: x != ""))
    stats = statistics(F.col("__text"))
    new = [c.cast("double").alias(f"__q_{k}") for k, c in stats.items()]
    return rows.select(*[cell(c).alias(c) for c in df.columns if c not in {f"__q_{k}" for k in stats}], *new), list(stats)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float] | None:
    """(gain, statistic, threshold) of the best split of rows with gradients g and curvatures h."""
    best = None
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        for cut in cuts:
            left = x[:, f] <= cut
            n = int(left.sum())
            if n < MIN_LEAF or len(x) - n < MIN_LEAF:
                continue
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = (float(gain), f, float(cut))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """The distinct paths of boosted trees on the logistic loss."""
    margin = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[Rule, None] = {}

    def node(rows: np.ndarray, path: Rule, g: np.ndarray, h: np.ndarray) -> None:
        if path:
            rules[path] = None
        found = _split(x[rows], g[rows], h[rows]) if len(path) < DEPTH and len(rows) >= 2 * MIN_LEAF else None
        if found is None:
            margin[rows] -= SHRINK * g[rows].sum() / (h[rows].sum() + 1.0)
            return
        _, f, cut = found
        low = x[rows, f] <= cut
        node(rows[low], (*path, (names[f], "<=", cut)), g, h)
        node(rows[~low], (*path, (names[f], ">", cut)), g, h)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        if np.abs(g).mean() < 0.01:
            break
        node(np.arange(len(y)), (), g, h)
    return list(rules)


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, sign, cut in rule:
        at = x[:, names.index(name)]
        out &= at <= cut if sign == "<=" else at > cut
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic model with an absolute penalty, by accelerated proximal steps."""
    n, p = r.shape
    r = r.astype(np.float64)
    w, b = np.zeros(p), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    z, zb, t = w.copy(), b, 1.0
    probe = np.ones(p + 1)
    for _ in range(30):  # the largest eigenvalue, for the step
        u = r @ probe[:p] + probe[p]
        probe = np.append(r.T @ u, u.sum())
        size = np.linalg.norm(probe)
        probe /= size
    step = 4.0 * n / size
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(r @ z + zb, -40, 40))) - y
        moved = z - step * (r.T @ error) / n
        w2 = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        b2 = zb - step * error.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


Model = tuple[float, list[tuple[float, Rule]]]


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """The intercept and the weighted rules that lasso keeps."""
    ones = y.sum()
    if not len(y) or ones in (0, len(y)):
        share = 0.5 if not len(y) else float(np.clip(ones / len(y), 0.001, 0.999))
        return math.log(share / (1 - share)), []
    seen: dict[bytes, Rule] = {}
    for rule in grow_rules(x, y, names):
        seen.setdefault(holds(rule, x, names).tobytes(), rule)  # of rules that hold for the same rows, the first
    rules = list(seen.values())
    if not rules:
        return math.log(ones / (len(y) - ones)), []
    b, w = lasso(np.stack([holds(rule, x, names) for rule in rules], axis=1), y)
    return float(b), [(float(v), rule) for v, rule in zip(w, rules, strict=True) if abs(v) > 1e-4]


def compiled(model: Model) -> Column:
    """The model as a Spark column over the columns of with_statistics()."""
    total = F.lit(model[0])
    for weight, rule in model[1]:
        held = F.lit(True)
        for name, sign, cut in rule:
            at = F.col(f"__q_{name}")
            held = held & (at <= F.lit(cut) if sign == "<=" else at > F.lit(cut))
        total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def learned(documents: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(documents, labels, "quality", HELD_OUT_MOD, HELD_OUT, LEARN_ROWS)
    stats, names = with_statistics(sample)
    rows = stats.select("label", *[f"__q_{n}" for n in names], "doc_id").collect()
    rows.sort(key=lambda r: tuple(r)[::-1])
    x = np.array([tuple(r)[1:-1] for r in rows], dtype=np.float64).reshape(-1, len(names))
    return fit(x, np.array([float(r.label == 1) for r in rows]), names)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    stats, _ = with_statistics(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))
    scored = stats.select("doc_id", held.alias("held_out"), compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, learned(documents, table(spark, sf_dir, "labels")))
