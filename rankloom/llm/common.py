"""What the operators share: tables, scratch tables in the shared folder, Arrow helpers.

Python workers get Arrow batches that Spark bounds in bytes (BATCH_BYTES, one value for all operators, set only
where the session still has Spark's default, so that it doesn't matter when a lazy plan runs). Within a batch an
operator turns only a slice of rows at a time into Python objects: see slices().
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_SCRATCH: list[str] = []  # paths of new_path(), until they are removed

#: Bytes of an Arrow batch that goes to a Python worker, and of a slice that becomes Python objects. A row may exceed either.
BATCH_BYTES, SLICE_BYTES, SLICE_ROWS = 8 << 20, 1 << 20, 1024
_BATCH_CONF, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without: it gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="rankloom-shared-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/rankloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind tables that saved() returned and that nothing reads any longer."""
    for df in tables:
        removed(df.sparkSession, df.scratch_path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what was saved within it, but for the tables that are put into the list it gives."""
    before, kept = set(_SCRATCH), []
    yield kept
    for path in [p for p in _SCRATCH if p not in before and p not in {k.scratch_path for k in kept}]:
        removed(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; frames that still read one can't be used after it."""
    removed(spark, f"{shared_dir(spark)}/rankloom/{spark.sparkContext.applicationId}")
    _SCRATCH.clear()


def arrow_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that go to Python workers, unless the session has its own bound."""
    if spark.conf.get(_BATCH_CONF).lower().removesuffix("b") in ("64m", str(_SPARK_DEFAULT)):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def _row_bytes(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        sizes, each = pc.list_value_length(column), 8
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        sizes, each = pc.binary_length(column), 1
    else:
        return np.full(len(column), 8, dtype=np.int64)
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) * each


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices (no copies) of at most `rows` rows and `size` bytes; a row over it is a slice of its own."""
    for b in batches:
        ends = np.cumsum(sum((_row_bytes(c) for c in b.columns), np.zeros(b.num_rows, dtype=np.int64)))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(max(int(np.searchsorted(ends, before + size, side="right")), at + 1), at + rows)
            yield b.slice(at, stop - at)
            at = stop
    released()


def released() -> None:
    """Give freed memory back at a task's end, as idle workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sliced(column: pa.Array, f: Callable[[pa.Array], list], kind: pa.DataType) -> pa.Array:
    """f of a column, a slice at a time."""
    parts = [pa.array(f(b.column(0)), type=kind) for b in slices(iter([pa.RecordBatch.from_arrays([column], names=["x"])]))]
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


def values(column: pa.Array) -> list:
    """A column of numbers, strings or bytes as Python objects (null: None); several times as fast as to_pylist()."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def quoted(name: str) -> str:
    """A column's name in expressions, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """(row, the named columns): df's rows as one struct, so that no name of a caller's column meets one of an operator's."""
    return df.select(F.struct(*[df[quoted(c)] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named.items()])


def cell(name: str) -> Column:
    """A caller's column of packed() rows."""
    return F.col(f"row.{quoted(name)}")


def unpacked(rows: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The caller's columns of packed() rows in their order, some of them replaced."""
    return rows.select(*[((new or {}).get(c) if c in (new or {}) else cell(c)).alias(c) for c in columns])


def texts(column: pa.Array) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [x or "" for x in values(column)]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, f in zip(columns, schema, strict=True)], schema=schema)
