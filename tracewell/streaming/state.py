"""Stateful streams with timers, and the same folds on batches: live state of jobs, claims that expire."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.sources.shared import cut, small

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400
LIVE = "job_id long, sequence long, names array<string>, held array<string>, live boolean"
GRANTED = "scope string, request_id long, granted boolean"


def millis(ts) -> int:
    import calendar

    return calendar.timegm(ts.timetuple()) * 1000 + ts.microsecond // 1000


class LiveState(StatefulProcessor):
    """Of a job: each field's last value by sequence number, where the last end was, and when the last event was.

    An event adds to the fields; an end takes those before it away, in whatever order they arrive; without an
    event for ttl seconds of event time all go. A row comes out for each change, with live false where nothing is left."""

    def __init__(self, terminal: str, ttl: int):
        self.terminal, self.ttl = terminal, ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "name string", "sequence long, value string")
        self.seen = handle.getValueState("seen", "last long, ended long, ts long")

    def _left(self) -> dict:
        return {k[0]: (v[0], v[1]) for k, v in self.fields.iterator()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  (Spark's names)
        last, ended, at = self.seen.get() if self.seen.exists() else (0, 0, 0)
        fields = self._left()
        for r in sorted(rows, key=lambda r: (r.ts, r.sequence)):
            now = millis(r.ts)
            if at and now > at + self.ttl:
                fields = {}
            at, last = max(at, now), max(last, r.sequence)
            if r.type == self.terminal:
                ended = max(ended, r.sequence)
                fields = {k: v for k, v in fields.items() if v[0] > ended}
            elif r.sequence > ended:
                for k, v in zip(r.names or [], r.held or [], strict=True):
                    if k not in fields or fields[k][0] < r.sequence:
                        fields[k] = (r.sequence, v)
        for k in [k for k in self._left() if k not in fields]:
            self.fields.removeKey((k,))
        for k, v in fields.items():
            self.fields.updateValue((k,), v)
        self.seen.update((last, ended, at))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if fields:
            self.handle.registerTimer(at + self.ttl)
        yield Row(job_id=key[0], sequence=last, names=list(fields), held=[v for _, v in fields.values()], live=bool(fields))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last = self.seen.get()[0]
        self.fields.clear()
        self.seen.clear()
        yield Row(job_id=key[0], sequence=last, names=[], held=[], live=False)

    def close(self) -> None:
        pass


def stream_live(events: DataFrame, terminal: str, ttl: int = DAY, late: str = "1 hour") -> DataFrame:
    """job_id, sequence, fields, live of a stream of events (job_id, sequence, ts, type, fields): a row for each job of a batch, and
    one when its time is over. Sets the session's state store to RocksDB, which state of this kind needs."""
    events.sparkSession.conf.set(STORE, ROCKS)
    flat = events.withWatermark("ts", late).select("job_id", "sequence", "ts", "type", F.map_keys("fields").alias("names"), F.map_values("fields").alias("held"))
    out = flat.groupBy("job_id").transformWithState(LiveState(terminal, ttl), LIVE, "Update", "EventTime")
    return out.select("job_id", "sequence", F.map_from_arrays("names", "held").alias("fields"), "live")


def live_fields(events: DataFrame, terminal: str, ttl: int = DAY, now: str | None = None) -> DataFrame:
    """job_id, sequence, fields of the jobs that are live at a time (after the last event, if not given): what stream_live's
    last rows hold. Fields are those since the last end and the last silence of over ttl seconds."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    by = Window.partitionBy("job_id")
    gap = F.unix_millis("ts") - F.lag(F.unix_millis("ts")).over(by.orderBy("ts", "sequence")) > ttl * 1000
    own = events.withColumn("part", F.sum(F.when(gap, 1).otherwise(0)).over(by.orderBy("ts", "sequence"))).withColumns({"newest": F.max("part").over(by), "ended": F.max(F.when(F.col("type") == terminal, F.col("sequence"))).over(by), "at": F.max("ts").over(by), "last": F.max("sequence").over(by)})
    left = own.where("part = newest").where((F.col("type") != terminal) & (F.col("sequence") > F.coalesce("ended", F.lit(0))))
    left = left if now is None else left.where(F.unix_millis("at") + ttl * 1000 > F.unix_millis(F.to_timestamp(F.lit(now))))
    each = left.select("job_id", "last", "sequence", F.explode("fields").alias("k", "v")).groupBy("job_id", "last", "k").agg(F.max_by("v", "sequence").alias("v"))
    return each.groupBy("job_id", F.col("last").alias("sequence")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))


class Claims(StatefulProcessor):
    """Of a scope: until when its claim holds. A request is granted where none does; a release ends it."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        until = self.until.get()[0] if self.until.exists() else None
        for r in sorted(rows, key=lambda r: (r.ts, r.request_id)):
            now = millis(r.ts)
            if r.release:
                until = None
                continue
            free = until is None or now >= until
            until = now + self.ttl if free else until
            yield Row(scope=key[0], request_id=r.request_id, granted=free)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if until is None:
            self.until.clear()
        else:
            self.until.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """A claim that is over leaves no state behind."""
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_claims(requests: DataFrame, ttl: int, late: str = "1 hour") -> DataFrame:
    """scope, request_id, granted of a stream of requests (scope, request_id, ts, release). Requests of a batch count in order of
    time; batches in order of arrival."""
    requests.sparkSession.conf.set(STORE, ROCKS)
    return requests.withWatermark("ts", late).groupBy("scope").transformWithState(Claims(ttl), GRANTED, "Append", "EventTime")


def claimed(requests: DataFrame, keys: list[str], at: str, id: str, ttl: int) -> DataFrame:
    """requests with granted: a request of the keys is granted if none was within `ttl` (units of the number `at`) before it. One that is
    not doesn't count for the next; ties go by id. No releases.

    Each request knows the first one that could be granted after it (one sorted pass in which every request also
    stands as a probe at its time plus ttl). The granted ones are the chain of these from the first on: it
    doubles with each join, so there are as many joins as the longest chain has binary digits. A group's requests
    are sorted in one task, with spill; nothing of them is held in memory."""
    by = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("event"), F.desc("i"))
    own = requests.select(*keys, F.col(at).alias("a"), F.col(id).alias("i"))
    both = own.select(*keys, F.col("a").alias("t"), F.lit(1).alias("event"), "i").union(own.select(*keys, (F.col("a") + ttl).alias("t"), F.lit(0), "i"))
    ahead = F.last(F.when(F.col("event") == 1, F.col("i")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    jump = cut(both.withColumn("next", ahead).where("event = 0").select(*keys, "i", "next").where("next IS NOT NULL"))
    taken = cut(own.groupBy(*keys).agg(F.min_by("i", F.struct("a", "i")).alias("i")))
    while not jump.isEmpty():
        on = jump.withColumnsRenamed({"next": "further", "i": "next"})
        reached = taken.join(jump, [*keys, "i"]).select(*keys, F.col("next").alias("i"))
        taken = cut(taken.union(reached).distinct())
        jump = cut(jump.join(on, [*keys, "next"]).select(*keys, "i", F.col("further").alias("next")))
    marked = taken.select(*keys, F.col("i").alias(id), F.lit(True).alias("granted"))
    return requests.join(small(marked, marked.count()), [*keys, id], "left").withColumn("granted", F.coalesce("granted", F.lit(False)))
