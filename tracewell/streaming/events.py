"""Job-event streams: order, gaps, retention, live state, limits, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.streaming.state import claimed

GAPS = "job_id long, sequence long, resync_from long"


def numbered(events: DataFrame) -> DataFrame:
    """job_id, sequence, ts, type, value from an event log: users are jobs. No event is left out."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.withColumn("sequence", seq).select(F.col("user_id").alias("job_id"), "sequence", "ts", F.col("event_type").alias("type"), "value", "event_id")


def with_gaps(numbered: DataFrame) -> DataFrame:
    """Numbered events without a seventh of them: made-up gaps."""
    return numbered.where("event_id % 7 <> 3")


def gaps(events: DataFrame) -> DataFrame:
    """job_id, sequence, resync_from: events before which, in order of arrival, numbers are missing."""
    before = F.lag("sequence").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    return events.withColumn("before", before).where("sequence > before + 1").select("job_id", "sequence", F.col("before").alias("resync_from"))


def _track(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before, out = state.get[0] if state.exists else None, []
    for rows in batches:
        for s in rows.sort_values(["ts", "event_id"]).sequence:
            if before is not None and s > before + 1:
                out.append((key[0], s, before))
            before = int(s)
    state.update((before,))
    yield pd.DataFrame(out, columns=["job_id", "sequence", "resync_from"])


def stream_gaps(events: DataFrame) -> DataFrame:
    """gaps() on a stream: the state of a job is its last number. A job's rows are put in order of time within
    an Arrow batch; from batch to batch they count in order of arrival."""
    return events.groupBy("job_id").applyInPandasWithState(_track, GAPS, "last long", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, late: str) -> DataFrame:
    """Each (job, sequence) once within the watermark, on a stream or a batch."""
    if not events.isStreaming:
        return events.dropDuplicates(["job_id", "sequence"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "sequence"])


def retained(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each job."""
    return events.withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("sequence")))).where(F.col("r") <= n).drop("r")


def live_state(events: DataFrame, terminal: str) -> DataFrame:
    """The last type and value of each job that has not ended."""
    last = events.groupBy("job_id").agg(F.max("sequence").alias("sequence"), F.max_by("type", "sequence").alias("type"), F.max_by("value", "sequence").alias("value"))
    return last.where(F.col("type") != terminal)


def backfill(events: DataFrame, since: int) -> DataFrame:
    """job_id, sequence, truncated: the events from a number on, and whether earlier ones are gone that it asks for."""
    first = events.groupBy("job_id").agg(F.min("sequence").alias("first"))
    return events.where(F.col("sequence") >= since).join(first, "job_id").select("job_id", "sequence", (F.col("first") > since).alias("truncated"))


def trimmed(events: DataFrame, pending: DataFrame, before: str) -> DataFrame:
    """events without those older than the given time, unless they are as new as the job's oldest pending one (job_id, sequence)."""
    oldest = pending.groupBy("job_id").agg(F.min("sequence").alias("oldest"))
    kept = (F.col("ts") >= F.lit(before).cast("timestamp")) | F.coalesce(F.col("sequence") >= F.col("oldest"), F.lit(False))
    return events.join(oldest, "job_id", "left").where(kept).select(events.columns)


def stuck(events: DataFrame, as_of: str, seconds: int) -> DataFrame:
    """Jobs without an event for so long."""
    last = events.groupBy("job_id").agg(F.max("ts").alias("last_ts"))
    return last.withColumn("age", (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_ts")).cast("long")).where(F.col("age") > seconds).select("job_id", "age")


def first_triggers(events: DataFrame, minutes: int) -> DataFrame:
    """job_id, type, event_id: events that trigger, which are those with no trigger of the same job and type
    within the minutes before them. An event that came too early doesn't count for the next one.

    Times count in whole seconds. See state.claimed for the plan."""
    asked = events.select("job_id", "type", "event_id", F.unix_timestamp("ts").alias("s"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    # Whole seconds first, then the order of events within a second.
    ranked = asked.withColumn("order", F.struct("us", "event_id"))
    return claimed(ranked, ["job_id", "type"], "s", "order", 60 * minutes + 1).where("granted").select("job_id", "type", "event_id")


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start_ts"), "type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "job_id").agg(F.count("*").alias("n")).select("job_id", F.col("w.start").alias("start_ts"), "n")


def rate_limited(events: DataFrame, interval_ms: int, tolerance_ms: int) -> DataFrame:
    """job_id, event_id, allowed: the generic cell rate algorithm, event by event in order of time.

    The state is one number per job, so a job's events stream through in sorted order."""

    def run(batches):
        now, tat = None, 0.0
        for rows in batches:
            allowed = []
            for job, ms in zip(rows.job_id, rows.ms, strict=True):
                if job != now:
                    now, tat = job, 0.0
                ok = ms >= tat - tolerance_ms
                if ok:
                    tat = max(tat, ms) + interval_ms
                allowed.append(ok)
            yield pd.DataFrame({"job_id": rows.job_id, "event_id": rows.event_id, "allowed": allowed})

    dealt = events.select("job_id", "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id")
    return dealt.mapInPandas(run, "job_id long, event_id long, allowed boolean")
