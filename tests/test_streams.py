"""The stream forms of the event operators, file by file, against the batch forms on all rows."""

import time

import pytest

from tracewell.streaming import events as ev

SCHEMA = "job_id long, sequence long, ts timestamp, type string, value double, event_id long"
FILES = [
    [(1, 1, "2024-01-01 00:00:00", "a", 1.0, 1), (1, 2, "2024-01-01 00:01:00", "b", 2.0, 2), (2, 1, "2024-01-01 00:02:00", "a", 1.5, 3)],
    [(1, 2, "2024-01-01 00:01:00", "b", 2.0, 2), (1, 5, "2024-01-01 00:11:00", "a", 4.0, 4), (2, 2, "2024-01-01 00:12:00", "a", 0.5, 5), (2, 4, "2024-01-01 00:13:00", "b", 0.25, 6)],
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    for rows in FILES:
        table = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).selectExpr("* except (ts)", "cast(ts as timestamp) ts")
        table.select("job_id", "sequence", "ts", "type", "value", "event_id").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in order of their times
    return path


def streamed(spark, folder, make, name, checkpoint):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    sink = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint))
    query = sink.trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_gaps_carry_over_batches(spark, folder, tmp_path):
    got = streamed(spark, folder, ev.stream_gaps, "gaps_out", tmp_path)
    batch = ev.gaps(spark.read.parquet(folder).dropDuplicates(["event_id"])).collect()
    assert got == sorted(tuple(r) for r in batch) == [(1, 5, 2), (2, 4, 2)]


def test_repeats_in_a_later_batch_go(spark, folder, tmp_path):
    got = streamed(spark, folder, lambda s: ev.deduplicated(s, "1 hour").select("job_id", "sequence"), "once_out", tmp_path)
    batch = ev.deduplicated(spark.read.parquet(folder), "1 hour").select("job_id", "sequence").collect()
    assert got == sorted(tuple(r) for r in batch) == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 4)]


def test_closed_windows_are_those_of_the_batch(spark, folder, tmp_path):
    got = streamed(spark, folder, lambda s: ev.tumbling(s, "10 minutes", "1 minute").select("type", "n", "total"), "windows_out", tmp_path)
    batch = ev.tumbling(spark.read.parquet(folder), "10 minutes").where("start_ts < '2024-01-01 00:10:00'").select("type", "n", "total").collect()
    assert got == sorted(tuple(r) for r in batch) == [("a", 2, 2.5), ("b", 2, 4.0)]
