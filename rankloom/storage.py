"""Where the engine keeps tables that outlive a plan: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may go without, and gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="rankloom-tables-")
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/rankloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename source to target, replacing what is there."""
    (a, fs), (b, _), (old, _) = _at(spark, source), _at(spark, target), _at(spark, f"{target}-replaced-{uuid.uuid4().hex}")
    fs.mkdirs(b.getParent())
    if fs.exists(b) and not fs.rename(b, old):
        raise OSError(f"could not rename {target}")
    if not fs.rename(a, b):
        raise OSError(f"could not rename {source} to {target}; what was there is at {old}")
    fs.delete(old, True)


def stored(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df written to path (in folders by the columns `by`) and read again."""
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
