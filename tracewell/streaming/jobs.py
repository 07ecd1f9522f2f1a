"""Job control as columns and folds: progress, transitions, recovery, queues, breakers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETRIES = 3


def progress(events: DataFrame, total: int) -> DataFrame:
    """job_id, processed, coverage (% of total, one decimal), eta_seconds at the pace so far."""
    by = events.groupBy("job_id").agg(F.max("sequence").alias("processed"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("elapsed"))
    left = F.greatest(F.lit(0), total - F.col("processed"))
    return by.select("job_id", "processed", F.round(F.least(F.lit(100.0), 100.0 * F.col("processed") / total), 1).alias("coverage"), F.floor(F.col("elapsed") * left / F.col("processed")).alias("eta_seconds"))


def may(action: str, status: Column, retries: Column) -> Column:
    """Whether a job may be cancelled, resumed or purged."""
    if action == "cancel":
        return status.isin("pending", "running")
    if action == "resume":
        return status.isin("failed", "cancelled") & (retries < MAX_RETRIES)
    return ~status.isin("pending", "running")


def recovery(status: Column, has_cursor: Column, retries: Column) -> Column:
    """What becomes of a job after a restart."""
    return F.when(status != "running", "none").when(has_cursor, "resume").when(retries + 1 > MAX_RETRIES, "failed").otherwise("retry")


def cached_read(age: Column, ttl: int, fresh: int, payload: Column) -> Column:
    """Why a cached answer is used, refreshed or missed."""
    return F.when(age.isNull(), "miss").when(age >= ttl, "expired").when(payload.isNull() | (payload == ""), "empty").when(age > fresh, "stale").otherwise("hit")


def retry_seconds(attempt: Column) -> Column:
    """The wait before the next attempt, without jitter: doubling from five seconds, two minutes at most."""
    return F.least(5 * F.pow(F.lit(2), attempt), F.lit(120)).cast("long")


def due(sources: DataFrame, config: DataFrame, least: int, default: int) -> DataFrame:
    """Sources (id, age) that are enabled and never polled or polled too long ago (config: id, enabled, every)."""
    every = F.greatest(F.coalesce("every", F.lit(default)), F.lit(least))
    return sources.join(config, "id", "left").where(F.coalesce("enabled", F.lit(True)) & (F.col("age").isNull() | (F.col("age") >= every)))


def queue_depth(pending: DataFrame) -> DataFrame:
    return pending.groupBy("type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


def dead_letters(deliveries: DataFrame, attempts: int = MAX_RETRIES) -> DataFrame:
    """job_id, type, n, dead: whether a message was delivered as often as it may be."""
    return deliveries.groupBy("job_id", "type").agg(F.count("*").alias("n")).withColumn("dead", F.col("n") >= attempts)


def health_counters(calls: DataFrame, failed: Column, width: str) -> DataFrame:
    """start_ts, type, ok, failed, last: successes and failures of each window, and its last value."""
    by = calls.groupBy(F.window("ts", width).alias("w"), "type")
    return by.agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"), F.max_by("value", F.struct("ts", "event_id")).alias("last")).select(F.col("w.start").alias("start_ts"), "type", "ok", "failed", "last")


def circuit_breaker(calls: DataFrame, failed: Column, failures: int = 3, reset_ms: int = 30_000) -> DataFrame:
    """job_id, event_id, state: `closed`, `open` (the call is refused) or `probe`, in order of time.

    So many failures in a row open a job's breaker; after reset_ms one probe closes it or opens it
    again. The state is two numbers, so a job's calls stream through in sorted order."""

    def run(batches):
        now, row, opened = None, 0, None
        for rows in batches:
            states = []
            for job, ms, bad in zip(rows.job_id, rows.ms, rows.bad, strict=True):
                if job != now:
                    now, row, opened = job, 0, None
                state = "closed" if opened is None else "probe" if ms - opened >= reset_ms else "open"
                if state != "open":
                    row = row + 1 if bad else 0
                    opened = ms if bad and (state == "probe" or row >= failures) else None
                states.append(state)
            yield pd.DataFrame({"job_id": rows.job_id, "event_id": rows.event_id, "state": states})

    dealt = calls.select("job_id", "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), failed.alias("bad")).repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id")
    return dealt.mapInPandas(run, "job_id long, event_id long, state string")
