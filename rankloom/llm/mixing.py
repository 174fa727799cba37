"""Mixing sources to target weights by hierarchical budgeting (operator 7).

The tree is domain - language - source. A budget of tokens flows from the root: siblings share their
parent's budget by weight; one whose whole subtree holds less than its share (tokens times MAX_EPOCHS) takes
what it has, and its siblings share the rest, so a shortage moves to ancestors' siblings only if the whole
family is short. That is water filling: with capacities c and weights w in order of c / w, the level is the
largest (B - sum of c before) / (sum of w from here on), all in integers and one division.

A leaf takes its budget as a prefix of seeded epochs: in epoch e its documents are in order of
md5(seed:e:doc_id); whole epochs are taken while the budget lasts, then a prefix. The prefix's end is found
in two levels, since a leaf can hold a third of all rows: sums of tokens by leaf and hash bucket (combined
on the map side), a running sum over buckets, and a window only inside the one bucket that the budget cuts.
It leaves one row a leaf - epochs and the last document's order - and the selection itself is a map.

Defined cases: null or empty text has no tokens, and is taken with its leaf's whole epochs, and in a cut one if it stands
before the cut; a very long text that the cut goes through gives its prefix (mixed_documents() keeps it whole); a null
language or source is a leaf of its own, "none"; a null doc_id is ordered by its text's digest; rows that share a doc_id are
rows of their own; ties are resolved by doc_id, then tokens; of rows alike in all these as many are taken as the budget has
tokens for, no matter which; a leaf without tokens selects nothing; an empty table gives no rows; other columns pass
through mixed_documents(), whatever their names; a language without a weight weighs DEFAULT_WEIGHT, and so do all domains
and sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import packed, saved, table, unpacked

SEED = 13
MAX_EPOCHS = 2
DEFAULT_WEIGHT = 10
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
DOMAINS = 4
#: Hexadecimal digits of a bucket: 4,096 buckets a leaf. A cut bucket is 1/4096 of its leaf.
BUCKET_DIGITS = 3
LEAF = ["domain", "lang", "source"]


def tokens_of(text: Column) -> Column:
    """Tokens are runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo DOMAINS, or "none"."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS INT)") % DOMAINS).cast("string")))


def leaves_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, name): a light row for each row."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        domain_of(F.col("source")).alias("domain"),
        F.coalesce("lang", F.lit("none")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"),
        tokens_of(F.col(text_col)).alias("n_tokens"),
        name.alias("name"),
    )


def _shared_out(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """children (with parent's columns, key, weight, capacity, parent_budget) and their budget."""
    inside = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = inside.orderBy((F.col("capacity") / F.col("weight")), key)
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = children.withColumn("level", level).withColumn("level", F.max("level").over(inside))
    return leveled.withColumn("budget", F.least(F.col("capacity"), F.floor(F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")).cast("long"))).drop("level", "parent_budget")


def budgets(light: DataFrame, total: Column | None = None, max_epochs: int = MAX_EPOCHS, weights: dict[str, int] | None = None) -> DataFrame:
    """(domain, lang, source, available, budget) for each leaf; total: the root's budget, all tokens by default."""
    weights = LANG_WEIGHTS if weights is None else weights
    leaf = light.groupBy(*LEAF).agg(F.sum("n_tokens").alias("available"))
    leaf = leaf.withColumn("capacity", F.col("available") * max_epochs)
    lang = leaf.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domain = lang.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    root = leaf.agg(F.sum("available").alias("n"), F.sum("capacity").alias("c")).select(F.least(F.col("c"), total if total is not None else F.col("n")).alias("parent_budget"))
    weight = F.lit(DEFAULT_WEIGHT).cast("long")
    by_lang = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in sorted(weights.items())], weight).cast("long") if weights else weight
    domain = _shared_out(domain.withColumn("weight", weight).crossJoin(F.broadcast(root)), [], "domain")  # root is one row
    up = domain.select("domain", F.col("budget").alias("parent_budget"))
    lang = _shared_out(lang.withColumn("weight", by_lang).join(up, "domain"), ["domain"], "lang")
    up = lang.select("domain", "lang", F.col("budget").alias("parent_budget"))
    return _shared_out(leaf.withColumn("weight", weight).join(up, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEAF, "available", "budget")


def _order(seed: int, epoch: Column, name: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), name).cast("binary"))


def plan(light: DataFrame, budget: DataFrame, seed: int = SEED) -> DataFrame:
    """A row a leaf: whole epochs, and the order of the last document of the cut one and the tokens it gives."""
    leaf = budget.where("available > 0").select(*LEAF, F.expr("budget div available").alias("epochs"), (F.col("budget") % F.col("available")).alias("rest"))
    rows = light.join(leaf.where("rest > 0"), LEAF).withColumn("o", _order(seed, F.col("epochs"), F.col("name")))
    rows = rows.withColumn("bucket", F.substring("o", 1, BUCKET_DIGITS))
    sums = rows.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).where("before < rest AND rest <= before + n")
    inside = rows.join(cut.select(*LEAF, "bucket", "before"), [*LEAF, "bucket"])
    upto = Window.partitionBy(*LEAF, "bucket").orderBy("o", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("upto", F.col("before") + F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)))
    # Rows that share a doc_id and a length are alike here: how many of them there are, and how many are taken.
    alike = inside.groupBy(*LEAF, "o", "doc_id", "n_tokens").agg(F.max(F.when(F.col("upto") < F.col("rest"), F.col("upto"))).alias("upto"), F.count_if(F.col("upto") < F.col("rest")).alias("taken"), F.count(F.lit(1)).alias("alike"))
    ends = alike.where("taken > 0").groupBy(*LEAF).agg(F.max(F.struct("o", "doc_id", "n_tokens", "upto", "taken", "alike")).alias("last"))
    return leaf.join(ends, LEAF, "left").select(*LEAF, "epochs", F.struct("last.o", "last.doc_id", "last.n_tokens").alias("last"), F.col("last.o").isNotNull().alias("cut"), (F.col("rest") - F.col("last.upto")).alias("last_take"), F.col("last.taken").alias("taken"), F.col("last.alike").alias("alike"))


def _taken(rows: DataFrame, leaves: DataFrame, keys: dict[str, str], mine: Column) -> DataFrame:
    """rows (joined with their leaf) with __more, whether the cut epoch takes them, and __end, whether it takes them in part.

    keys: names of the leaf's columns in rows. Of alike rows at the cut only as many as the budget has are taken; they alone are numbered.
    """
    cut, last = F.col(keys["cut"]), F.col(keys["last"])
    at_end = F.coalesce(cut & (mine == last), F.lit(False))
    known = rows.withColumn("__more", F.coalesce(cut & (mine <= last), F.lit(False))).withColumn("__end", at_end)
    if not leaves.where("alike > 1").limit(1).count():
        return known
    nth = F.row_number().over(Window.partitionBy(*[keys[c] for c in LEAF]).orderBy(F.lit(0)))
    tied = known.where("__end").withColumn("__nth", nth)
    tied = tied.withColumns({"__more": F.col("__nth") <= F.col(keys["taken"]), "__end": F.col("__nth") == F.col(keys["taken"])}).drop("__nth")
    return known.where("NOT __end").unionByName(tied)


def selected(light: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """light's rows once for each epoch that takes them: epoch, and take_tokens (less than n_tokens only at a prefix's end)."""
    rows = light.join(leaves, LEAF).withColumn("o", F.when(F.col("cut"), _order(seed, F.col("epochs"), F.col("name"))))
    rows = _taken(rows, leaves, {c: c for c in leaves.columns}, F.struct("o", "doc_id", "n_tokens"))
    copies = F.col("epochs") + F.col("__more").cast("long")
    rows = rows.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    take = F.when(F.col("__end") & (F.col("epoch") == F.col("epochs")), F.col("last_take")).otherwise(F.col("n_tokens"))
    return rows.withColumn("take_tokens", take).drop("o", "__more", "__end", "epochs", "last", "cut", "last_take", "taken", "alike")


def mix(df: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch, take_tokens) of what the mixture takes."""
    light = saved(leaves_of(df), "leaves")
    leaves = saved(plan(light, saved(budgets(light, **options), "budgets"), seed), "leaf-plan")
    return selected(light, leaves, seed).drop("name")


def mixed_documents(df: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """df's rows that the mixture takes, once for each epoch, whole (a cut document stays whole), columns as they are."""
    light = saved(leaves_of(df), "leaves")
    leaves = saved(plan(light, saved(budgets(light, **options), "budgets"), seed), "leaf-plan")
    keys = {c: f"leaf_{c}" for c in leaves.columns}
    rows = packed(
        df, leaf_domain=domain_of(F.col("source")), leaf_lang=F.coalesce("lang", F.lit("none")), leaf_source=F.coalesce("source", F.lit("none")),
        name=F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))), n=tokens_of(F.col("text")),
    ).join(leaves.withColumnsRenamed(keys), [keys[c] for c in LEAF])
    mine = F.struct(_order(seed, F.col("leaf_epochs"), F.col("name")).alias("o"), F.col("row.doc_id").cast("long").alias("doc_id"), F.col("n").alias("n_tokens"))
    copies = F.col("leaf_epochs") + F.col("__more").cast("long")
    taken = _taken(rows, leaves, keys, mine).where(copies > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("epoch"))
    return unpacked(taken, df.columns)


def op7_mixture(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


_WEIGHT = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items()) + f" ELSE {DEFAULT_WEIGHT} END"


def _sql_level(name: str, source: str, parent: str, key: str, weight: str) -> str:
    """SQL of _shared_out(): source has capacity and parent_budget."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_0 AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM {source}),
{name}_1 AS (SELECT *, CAST(parent_budget - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    / CAST(sum(weight) OVER ({part} ORDER BY capacity / weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM {name}_0),
{name} AS (SELECT * EXCLUDE (level, weight, parent_budget), least(capacity, CAST(floor(greatest(max(level) OVER ({part}), 0) * weight) AS BIGINT)) AS budget FROM {name}_1)"""


ORACLE_SQL = f"""
WITH light AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'none'
           ELSE 'domain' || CAST(CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT) % {DOMAINS} AS VARCHAR) END AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS n_tokens,
         coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, ''))) AS name
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS capacity FROM light GROUP BY ALL),
d_in AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, (SELECT CAST(least(sum(available), sum(capacity)) AS BIGINT) FROM leaf) AS parent_budget FROM leaf GROUP BY domain),
{_sql_level("d", "d_in", "", "domain", str(DEFAULT_WEIGHT))},
l_in AS (SELECT domain, lang, CAST(sum(leaf.capacity) AS BIGINT) AS capacity, any_value(d.budget) AS parent_budget FROM leaf JOIN d USING (domain) GROUP BY domain, lang),
{_sql_level("l", "l_in", "domain", "lang", _WEIGHT)},
s_in AS (SELECT leaf.*, l.budget AS parent_budget FROM leaf JOIN l USING (domain, lang)),
{_sql_level("s", "s_in", "domain, lang", "source", str(DEFAULT_WEIGHT))},
rows AS (SELECT light.*, budget // available AS epochs, budget % available AS rest FROM light JOIN s USING (domain, lang, source) WHERE available > 0),
upto AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || CAST(epochs AS VARCHAR) || ':' || name), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows),
copies AS (SELECT *, unnest(range(0, epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS epoch FROM upto)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS BIGINT) AS epoch,
  CAST(CASE WHEN epoch = epochs THEN least(n_tokens, rest - before) ELSE n_tokens END AS BIGINT) AS take_tokens
FROM copies
"""
