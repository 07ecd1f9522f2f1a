"""Stateful streams with timers against plain folds, over batches, restarts and late rows."""

import datetime
import random
import time

import pytest

from tracewell.streaming import state

EVENTS = "job_id long, sequence long, ts timestamp, type string, fields map<string,string>"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(1.1)  # files are read in order of their times


def run(spark, folder, schema, make, name, checkpoint, mode):
    """All files so far, one a batch, from the checkpoint on."""
    out = str(checkpoint) + "-out"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    sink = make(source).writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint))
    query = sink.foreachBatch(lambda df, i: df.selectExpr("*", f"{i} AS batch").write.mode("append").parquet(out)).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return spark.read.parquet(out)


def last_of(rows):
    """The last row of each job."""
    out = {}
    for r in sorted(rows, key=lambda r: r.batch):
        out[r.job_id] = (r.sequence, dict(r.fields)) if r.live else None
    return {k: v for k, v in out.items() if v}


def test_live_state_over_restarts_and_late_rows(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", tmp_path / "cp"
    first = [(1, 1, at(0), "start", {"a": "1"}), (1, 3, at(4), "step", {"a": "3", "b": "x"}), (2, 1, at(1), "start", {"a": "9"}), (3, 1, at(2), "start", {"q": "1"})]
    second = [(1, 2, at(3), "step", {"a": "2", "c": "late"}), (2, 2, at(6), "end", {}), (4, 1, at(7), "start", None)]
    third = [(2, 4, at(9), "step", {"z": "1"}), (1, 4, at(10), "step", {"b": "y"}), (3, 2, at(20), "step", {"r": "2"})]
    # Nothing is heard of jobs 1 to 4 for over 30 minutes of event time, and the watermark passes that.
    fourth = [(5, 1, at(200), "start", {"n": "1"})]
    fifth = [(5, 2, at(201), "step", {"m": "2"})]
    make = lambda s: state.stream_live(s, "end", 1800, "10 minutes")
    for rows in (first, second):
        write(spark, folder, rows, EVENTS)
    out = run(spark, folder, EVENTS, make, "live", checkpoint, "update")
    assert last_of(out.collect()) == {1: (3, {"a": "3", "b": "x", "c": "late"}), 3: (1, {"q": "1"})}
    write(spark, folder, third, EVENTS)
    out = run(spark, folder, EVENTS, make, "live", checkpoint, "update")  # goes on from the stored state
    assert last_of(out.collect()) == {1: (4, {"a": "3", "b": "y", "c": "late"}), 2: (4, {"z": "1"}), 3: (2, {"q": "1", "r": "2"})}
    so_far = spark.createDataFrame([*first, *second, *third], EVENTS)
    assert {r.job_id: (r.sequence, dict(r.fields)) for r in state.live_fields(so_far, "end", 1800).collect()} == last_of(out.collect())
    for rows in (fourth, fifth):
        write(spark, folder, rows, EVENTS)
    out = run(spark, folder, EVENTS, make, "live", checkpoint, "update")
    assert last_of(out.collect()) == {5: (2, {"n": "1", "m": "2"})}
    # Job 1 begins anew after its silence.
    write(spark, folder, [(1, 5, at(202), "step", {"k": "1"})], EVENTS)
    fourth.append((1, 5, at(202), "step", {"k": "1"}))
    out = run(spark, folder, EVENTS, make, "live", checkpoint, "update")
    assert last_of(out.collect()) == {1: (5, {"k": "1"}), 5: (2, {"n": "1", "m": "2"})}
    every = spark.createDataFrame([*first, *second, *third, *fourth, *fifth], EVENTS)
    assert {r.job_id for r in state.live_fields(every, "end", 1800, "2024-01-01 03:11:00").collect()} == {1, 5}


REQUESTS = "scope string, request_id long, ts timestamp, release boolean"


def fold(rows, ttl):
    until, out = {}, {}
    for scope, i, ts, release in sorted(rows, key=lambda r: (r[2], r[1])):
        if release:
            until.pop(scope, None)
        else:
            out[i] = scope not in until or ts >= until[scope]
            if out[i]:
                until[scope] = ts + datetime.timedelta(seconds=ttl)
    return out


def test_claims_over_batches(spark, tmp_path):
    r, rows = random.Random(4), []
    for i in range(60):
        rows.append((r.choice("ab"), i, at(2 * i + r.random()), r.random() < 0.1))
    for part in (rows[:20], rows[20:40], rows[40:]):
        write(spark, tmp_path / "in", part, REQUESTS)
    out = run(spark, tmp_path / "in", REQUESTS, lambda s: state.stream_claims(s, 600, "10 minutes"), "claims", tmp_path / "cp", "append")
    assert {x.request_id: x.granted for x in out.collect()} == fold(rows, 600)


@pytest.mark.parametrize("ttl", [1, 25, 10_000])
def test_claims_of_a_batch(spark, ttl):
    r = random.Random(ttl)
    rows = [(r.choice("abc"), i, at(r.randrange(40) / 60), False) for i in range(200)]
    df = spark.createDataFrame(rows, REQUESTS).selectExpr("scope", "request_id", "unix_timestamp(ts) AS s")
    got = {x.request_id: x.granted for x in state.claimed(df, ["scope"], "s", "request_id", ttl).collect()}
    assert got == fold(rows, ttl)
    assert state.claimed(df.limit(0), ["scope"], "s", "request_id", ttl).count() == 0
