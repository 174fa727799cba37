"""Columns of any name pass through the pipeline's stages unchanged; token files are read by another session."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankloom.llm import mixing, packing, quality, secrets, simhash, token_files, tokens, toxicity

NAMES = ("__n", "__end", "__more", "__nth", "__epoch", "__domain", "__lang", "__source", "__name", "__clean", "__doc", "__again", "__row", "__text", "__words", "row", "doc", "clean", "leaf_lang", "n", "a.b", "a`b", "count")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    words = [" ".join(f"w{(7 * i + k) % 50}" for k in range(12)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(words)] + [(20, words[0], "de", "s1", 3), (21, "password = 'hunter2hunter2'", None, None, 27), (5, words[5] + " x", "en", "s2", 9), (5, words[5] + " x", "en", "s2", 9)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in NAMES])


def same_columns(before, after, changed=("text", "n_chars")):
    assert after.columns == before.columns
    kept = [c for c in before.columns if c not in changed]
    have = {tuple(r) for r in before.select(*[before[f"`{c.replace('`', '``')}`"] for c in kept]).collect()}
    rows = after.select(*[after[f"`{c.replace('`', '``')}`"] for c in kept]).collect()
    assert rows and {tuple(r) for r in rows} <= have
    return rows


def test_mixture(spark):
    assert len(same_columns(documents(spark), mixing.mixed_documents(documents(spark)), ())) >= 10


def test_mixture_with_a_cut_among_alike_rows(spark):
    df = documents(spark).where("doc_id = 5")
    assert len(same_columns(df, mixing.mixed_documents(df, total=F.lit(20)), ())) >= 1


def test_redaction(spark):
    rows = same_columns(documents(spark), secrets.redact(documents(spark)))
    assert len(rows) == 16
    assert "hunter2" not in secrets.redact(documents(spark)).where("doc_id = 21").first().text


def test_near_duplicates(spark):
    rows = same_columns(documents(spark), simhash.without_near_duplicates(documents(spark)), ())
    assert sorted(r.doc_id for r in rows) == [*range(12), 21]


def test_toxicity_and_statistics(spark):
    df = documents(spark)
    assert len(same_columns(df, toxicity.without_toxic(df, {"hate": 3.0}), ())) == 16
    stats, names = quality.with_statistics(df)
    assert len(same_columns(df, stats.drop(*[f"__q_{n}" for n in names]), ())) == 16
    assert stats.where("doc_id = 0").first()["__q_words"] == 12.0
    assert quality.with_statistics(stats)[0].columns == stats.columns


def test_packing(spark):
    df = documents(spark)
    want = sorted(map(tuple, packing.pack(df.select("doc_id", "text"), tokens.vocabulary("word_bpe_49k.json")).select("doc_id", "start", "length").collect()))
    assert sorted(map(tuple, packing.pack(df, tokens.vocabulary("word_bpe_49k.json")).select("doc_id", "start", "length").collect())) == want


READER = """
import sys
from pyspark.sql import SparkSession
from rankloom.llm import token_files
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
for r in token_files.read_files(spark, sys.argv[1]).orderBy("start").collect():
    print("row", r.doc_id, r.start, r.n_tokens, r.ids_crc32)
"""


def test_token_files_in_a_new_session(spark, tmp_path):
    path, df = str(tmp_path / "files"), documents(spark).select("doc_id", "text")
    ids = token_files.tokenized(df, tokens.vocabulary("byte_bpe_50k.json"))
    token_files.write_files(ids, token_files.rank_table(ids), path, 3)
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", READER, path], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    got = [tuple(map(int, line.split()[1:])) for line in done.stdout.splitlines() if line.startswith("row")]
    assert got == [tuple(r) for r in token_files.read_files(spark, path).orderBy("start").collect()], done.stderr[-500:]
    assert len(got) == 16 and got[0][0] == 0
    (tmp_path / "other").mkdir()
    token_files._write_ranks(spark, token_files.rank_table(ids)[:5], str(tmp_path / "other"))
    assert len(token_files.read_ranks(spark, str(tmp_path / "other"))) == 5


def test_damaged_ranks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0, bytearray(b"12345678"))], token_files._RANKS)
    rows.write.parquet(f"{tmp_path}/_ranks")
    with pytest.raises(ValueError, match="damaged"):
        token_files.read_ranks(spark, str(tmp_path))
