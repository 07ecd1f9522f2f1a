"""The circuit breaker, call by call."""

from pyspark.sql import functions as F

from tracewell.plans import catalogue
from tracewell.streaming import events
from tracewell.streaming.jobs import circuit_breaker


def test_circuit_breaker(spark):
    seconds = [0, 1, 2, 3, 31, 32, 61, 62]
    bad = [True, True, True, False, True, False, False, True]
    want = ["closed", "closed", "closed", "open", "open", "probe", "closed", "closed"]
    rows = [(job, i, s, b) for job in (1, 2) for i, (s, b) in enumerate(zip(seconds, bad, strict=True))]
    calls = spark.createDataFrame(rows, "job_id long, event_id long, s long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    out = circuit_breaker(calls, F.col("bad")).collect()
    for job in (1, 2):
        assert [r.state for r in sorted((r for r in out if r.job_id == job), key=lambda r: r.event_id)] == want


def test_a_failed_probe_opens_again(spark):
    rows = [(1, i, s, True) for i, s in enumerate([0, 1, 2, 40, 41, 70])]
    calls = spark.createDataFrame(rows, "job_id long, event_id long, s long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    out = sorted(circuit_breaker(calls, F.col("bad")).collect(), key=lambda r: r.event_id)
    assert [r.state for r in out] == ["closed", "closed", "closed", "probe", "open", "probe"]


def test_folds_over_calls_see_every_event(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    ids = sorted(r.event_id for r in log.select("event_id").collect())
    for name in ("gcra_fold", "circuit_breaker"):
        assert sorted(r.event_id for r in catalogue.queries()[name](spark, sf_dir).collect()) == ids
    assert not events.gaps(events.numbered(log)).count()
