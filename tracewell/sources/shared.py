"""Tables in the folder that the cluster shares: kept ones, and cuts in the lineage of iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns up to which a counted table is broadcast: some 10 MB of urns.
BROADCAST_ROWS = 100_000
_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; the warehouse, which a cluster shares too, where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from there, which cuts the plan of an iteration: a stored table, so later
    steps read the columns they need and know its size."""
    return stored(df, "cut")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tracewell-graph-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    if folder not in _folders:
        _folders.add(folder)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows, with a broadcast hint if they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
