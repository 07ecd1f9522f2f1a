"""Helpers shared by the operators: shared tables, sized joins, Arrow columns, hashing rules."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; in the warehouse, which a cluster shares too,
    where that is unset."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tracewell-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage. The folder
    goes when the application ends as it should; an operator's result reads from it until then."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _folders:
        _folders.add(folder)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


_folders: set[str] = set()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise wrote and that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (df must be cheap to count, as a
    materialised table is); otherwise Spark joins by shuffle and may split skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, case ignored."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of a column that Python handles at once.
SLICE = 1 << 22
#: Rows that Spark sends to Python at once; texts may be long, and a batch is whole in memory on both sides.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose column takes about SLICE bytes (one row at least)."""
    for at, to in runs_by_size(sizes_of(batch.column(column)), SLICE):
        yield batch.slice(at, to - at)


def sizes_of(array: pa.Array) -> list[int]:
    """Bytes of each text, or elements of each list."""
    is_list = pa.types.is_list(array.type) or pa.types.is_large_list(array.type)
    return (pc.list_value_length(array) if is_list else pc.binary_length(array)).fill_null(0).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in a batch to BATCH_ROWS."""
    if not 0 < int(spark.conf.get(BATCH_KEY, "0")) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def append_arrow(df: DataFrame, fields: list[StructField], start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], sized: str | None = None) -> DataFrame:
    """df with more columns, made in Python; start() runs once per task. A batch goes in slices by the
    bytes of column sized (one of texts or lists), so that long texts don't meet in memory. For the same
    reason the session's limit of rows in a batch is lowered to BATCH_ROWS.

    Columns of df whose names clash with the new ones give way to them."""
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    names = [c for c in df.columns if c not in new]
    kept = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])  # mapInArrow can't have dots in names
    schema = StructType([*kept.schema.fields, *[StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = None
        for batch in batches:
            make = make or start()
            batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
            for part in slices(batch, sized) if sized else [batch]:
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part)], names=schema.names)

    return kept.mapInArrow(run, schema).toDF(*names, *[f.name for f in fields])


def texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def runs_by_size(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring items that hold about so many bytes (one item at least)."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def mix64(x: np.ndarray, c: int) -> np.ndarray:
    """A multiplicative 64-bit hash; its upper bits are the well mixed ones."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(c)
    return x ^ (x >> np.uint64(32))


#: Whole numbers below this are exact in a double.
EXACT = 1 << 53


def quantised(values: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) of rows of doubles: doubles where they hold it exactly, else Python integers."""
    c = np.array(values, float).reshape(len(values), -1)
    if np.abs(c).max(initial=0) < EXACT // scale:
        return np.floor(c * scale)
    return np.array([[math.floor(x * scale) if abs(x) < EXACT else int(x) * scale for x in row] for row in c.tolist()], object).reshape(c.shape)


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers (of any type) in the least integer type that holds them; digits where none does."""
    most = np.abs(x).max(initial=0)
    kind = next((k for k, n in (("int8", 1 << 7), ("int16", 1 << 15), ("int32", 1 << 31), ("int64", 1 << 62)) if most < n), "digits")
    return kind, " ".join(map(str, x.ravel())).encode() if kind == "digits" else x.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, *shape: int) -> np.ndarray:
    """What packed() made, as int64 or Python integers."""
    x = np.array([int(d) for d in data.split()], object) if kind == "digits" else np.frombuffer(data, kind).astype(np.int64)
    return x.reshape(shape)
