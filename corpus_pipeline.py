"""The corpus pipeline: its stages filter, clean, mix and pack documents.

Defined cases are those of the stages' operators. A null text is a document without words: it is kept by toxicity, a copy of
all other texts without words, has no secrets and no tokens, and no epoch of a mixture needs it. A null doc_id is kept by
the near-duplicate stage. Very long texts go whole through each stage. Rows that share a doc_id are one document to the
near-duplicate stage, which keeps the one with the smallest text. An empty table gives an empty one. Columns beside those
of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import stages
from rankloom.llm.common import dropped, saved, swept, table
from rankloom.session import ship_package

STAGES = [
    ("toxicity", stages.toxicity),
    ("near duplicates", stages.near_duplicates),
    ("secret scan", stages.secret_scan),
    ("mixture", stages.mixture),
    ("packing", stages.pack),
]

#: SQL can express neither the learned lexicon, the lexer nor the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's input."""
    ship_package(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with swept(spark) as kept:  # what a stage saved on its way goes, and so does its predecessor's result
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
