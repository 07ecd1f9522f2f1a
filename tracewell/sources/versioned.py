"""Stored tables that change as a whole: a reader sees one version or the next, whatever a writer dies of.

A version is a folder of Parquet files; which ones count is told by numbered pointer files of one line. A writer
writes its folder first and then creates the pointer of the next number, which fails if there is one: of two
writers that began from the same version one gets an error. A folder without a pointer is what a lost writer left."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "_pointers"


class Conflict(RuntimeError):
    """Another writer has published a version in the meantime."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def latest(spark: SparkSession, path: str) -> Version | None:
    """The version that readers see; None before the first one."""
    store, at = _path(spark, f"{path}/{POINTERS}")
    if not store.exists(at):
        return None
    names = [s.getPath().getName() for s in store.listStatus(at)]
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return None
    with_line = store.open(_path(spark, f"{path}/{POINTERS}/{max(numbers):012d}")[1])
    try:
        line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(with_line)).readLine()
    finally:
        with_line.close()
    # A pointer without its line is one whose writer was lost between the two: the version before it counts.
    if not line:
        return _earlier(spark, path, sorted(numbers)[:-1])
    return Version(max(numbers), line)


def _earlier(spark: SparkSession, path: str, numbers: list[int]) -> Version | None:
    for n in reversed(numbers):
        line = spark.read.text(f"{path}/{POINTERS}/{n:012d}").first()
        if line and line[0]:
            return Version(n, line[0])
    return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of now. Files of a version are never changed, so a query that has begun goes on with its version."""
    now = latest(spark, path)
    if now is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(f"{path}/{now.folder}")


def prepare(df: DataFrame, path: str, *partition_by: str) -> str:
    """Writes a version that no one sees yet; returns its folder."""
    folder = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    return folder


def publish(spark: SparkSession, path: str, folder: str, before: Version | None) -> Version:
    """Makes a prepared version the one that readers see, if `before` still is."""
    number = before.number + 1 if before else 1
    store, at = _path(spark, f"{path}/{POINTERS}/{number:012d}")
    try:
        out = store.create(at, False)
    except Exception as e:  # the file system's own kinds of "exists already"
        if store.exists(at):
            raise Conflict(f"{path} has a version {number} by now") from e
        raise
    try:
        out.write(bytearray(folder, "utf-8"))
    finally:
        out.close()
    return Version(number, folder)


def replace(df: DataFrame, path: str, *partition_by: str) -> Version:
    """df as the next version."""
    spark = df.sparkSession
    before = latest(spark, path)
    return publish(spark, path, prepare(df, path, *partition_by), before)


def merge(spark: SparkSession, path: str, keys: list[str], upserts: DataFrame | None = None, deletes: DataFrame | None = None, *partition_by: str) -> Version:
    """The next version: rows of deletes (keys) go, then rows of upserts come, in place of those with the same keys. Of
    upserts that repeat a key one stays, the largest by all columns. Rows that neither names are copied."""
    before = latest(spark, path)
    old = read(spark, path)
    out = old.join(deletes.select(*keys).distinct(), keys, "left_anti") if deletes is not None else old
    if upserts is not None:
        rest = [c for c in old.columns if c not in keys]
        once = upserts.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("x")).select(*keys, "x.*").select(*old.columns) if rest else upserts.select(*keys).distinct()
        out = out.join(once.select(*keys), keys, "left_anti").select(*old.columns).union(once)
    return publish(spark, path, prepare(out.select(*old.columns), path, *partition_by), before)


def purge(spark: SparkSession, path: str) -> tuple[Version, int]:
    """An empty next version, and how many rows went."""
    old = read(spark, path)
    return replace(old.limit(0), path), old.count()


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the folders of all but the last versions, and those that no pointer names; returns how many. Not while a writer is at work."""
    store, at = _path(spark, path)
    now = latest(spark, path)
    first = max(1, (now.number if now else 0) - keep + 1)
    named = {r[0] for n in range(first, (now.number if now else 0) + 1) for r in spark.read.text(f"{path}/{POINTERS}/{n:012d}").collect()}
    gone = [s.getPath() for s in store.listStatus(at) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in named]
    for p in gone:
        store.delete(p, True)
    return len(gone)
