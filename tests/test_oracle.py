"""Every query of the engine with oracle SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from rankloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def canon(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


def same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    same(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_llm(spark, tmp_path):
    """The entry module imports, and has the engine's queries, without the optional part."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "rankloom", tmp_path / "rankloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print('bm25_topk' in q, 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == ["True", "False"], done.stderr
