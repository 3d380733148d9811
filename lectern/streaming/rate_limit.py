"""Sliding-window rate limits: a stateful stream and its batch twin."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

from lectern.session import cut_lineage, stored

# Fixed values: (requests, window in seconds) of sign-in, general and generation calls.
LIMITS = {"auth": (10, 15 * 60), "api": (100, 60), "generation": (20, 60)}
#: Requests of one key that a task folds in a row, more or less (a window is never cut).
SEGMENT_ROWS = 1 << 20


def admit(now: int, log: deque, limit: int, window: int) -> int:
    """Fold one request into the log of accepted times: its retry delay, 0 if accepted."""
    while log and log[0] <= now - window:
        log.popleft()
    if len(log) < limit:
        log.append(now)
        return 0
    return max(1, log[0] + window - now)


def segments(rows: DataFrame, limit: int, segment_rows: int) -> DataFrame:
    """(key, slot, run, seg, part) for rows(key, slot): where a key's timeline can be folded apart.

    Slots are one window long, so a request looks back into its own and the last slot only. An empty slot starts a new
    run. A slot that has no more than ``limit`` requests together with the one before accepts them all, whatever came
    earlier: the next slot may start a new segment, led in by these requests. A run is cut there once it has
    grown by ``segment_rows``. Where it grows by as much without such a slot, it is cut into parts whose start is not known.
    """
    counts = rows.groupBy("key", "slot").agg(F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy("slot")
    before = F.coalesce(F.when(F.lag("slot").over(order) == F.col("slot") - 1, F.lag("n").over(order)), F.lit(0))
    slots = counts.withColumn("n_before", before).withColumn("quiet", F.col("n") + F.col("n_before") <= limit)
    slots = slots.withColumn("anchor", (F.col("n_before") > 0) & F.coalesce(F.lag("quiet").over(order), F.lit(False)))
    slots = slots.withColumn("run", F.sum((F.col("n_before") == 0).cast("int")).over(order))

    def passed(*unit: str):
        return F.floor((F.sum("n").over(Window.partitionBy("key", *unit).orderBy("slot")) - F.col("n")) / segment_rows)

    in_run = Window.partitionBy("key", "run").orderBy("slot")
    slots = slots.withColumn("grown", passed("run")).withColumn("seg", F.coalesce(F.max(F.when(F.col("anchor"), F.col("grown"))).over(in_run), F.lit(0)))
    slots = slots.withColumn("grown", passed("run", "seg"))
    # A slot may be larger than a part, so parts are numbered anew.
    part = F.dense_rank().over(Window.partitionBy("key", "run", "seg").orderBy("grown")) - 1
    return slots.withColumn("part", part.cast("bigint")).select("key", "slot", "run", "seg", "part")


_GROUP = ("key", "run", "seg", "part")


def _fold(rows: DataFrame, limit: int, window: int) -> DataFrame:
    """Decisions (tail false) and the log at the end of every group (tail true) of rows(group, us, id, lead)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in (*_GROUP, "id", "us")) + ", retry_us bigint, tail boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, log, types = None, deque(), None

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            names = [*_GROUP, "id", "us", "retry_us", "tail"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(c) for c in (*_GROUP, "id", "us", "lead")]
            types = [*(c.type for c in columns[:-1]), pa.int64(), pa.bool_()]
            out = []
            for *own, ident, us, lead in zip(*(c.to_pylist() for c in columns), strict=True):
                if own != group:
                    out += [(*group, None, t, None, True) for t in log] if group else []
                    group, log = own, deque()
                if lead:
                    log.append(us)
                else:
                    out.append((*own, ident, us, admit(us, log, limit, window), False))
            if out:
                yield made(out)
        if log:
            yield made([(*group, None, t, None, True) for t in log])

    dealt = rows.select(*_GROUP, "id", "us", "lead").repartition(*_GROUP).sortWithinPartitions(*_GROUP, F.desc("lead"), "us", "id")
    return dealt.mapInArrow(run, ddl)


def batch_limits(requests: DataFrame, limit: int, seconds: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """requests(key, ts, id) with ``allowed`` and ``retry_us`` by the sliding rule; rows without key or time are left out.

    A key's timeline is cut where the log is known (``segments``); every piece is folded as a stream of sorted rows that
    keeps only the log. Pieces that start in the middle of a busy stretch are folded from an empty log and again
    whenever the piece before ends with another log than they began with: at most one round for each such piece.
    """
    window = seconds * 1_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = requests.select("key", "id", us.alias("us")).filter(F.col("key").isNotNull() & F.col("us").isNotNull())
    rows = rows.withColumn("slot", F.floor(F.col("us") / window))
    slots = cut_lineage(segments(rows, limit, segment_rows))
    dealt = rows.join(slots, ["key", "slot"])
    started = dealt.select(*_GROUP, "id", "us", F.lit(False).alias("lead"))
    no_id = F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id")
    into = slots.groupBy("key", "run", "seg").agg((F.min("slot") - 1).alias("slot")).filter("seg > 0")
    if not into.isEmpty():
        led = rows.join(into, ["key", "slot"])
        started = started.unionByName(led.select("key", "run", "seg", F.lit(0).cast("bigint").alias("part"), no_id, "us", F.lit(True).alias("lead")))
    decided = _fold(started, limit, window)
    if slots.filter("part > 0").isEmpty():
        return _decisions(decided)

    def logs(decided: DataFrame) -> DataFrame:
        """The log each part should begin with, from the ends of the parts before."""
        return decided.filter("tail").groupBy(*_GROUP).agg(F.sort_array(F.collect_list("us")).alias("log")).withColumn("part", F.col("part") + 1)

    rounds = [stored(decided, "limits")]
    wanted = cut_lineage(logs(rounds[0]).join(slots.filter("part > 0").select(*_GROUP).distinct(), [*_GROUP], "left_semi"))
    used = wanted.withColumn("log", F.array().cast("array<bigint>"))
    moved = wanted
    latest = rounds[0].select(*_GROUP).distinct().withColumn("round", F.lit(0))
    while not moved.isEmpty():
        again = dealt.join(moved.select(*_GROUP), [*_GROUP], "left_semi").select(*_GROUP, "id", "us", F.lit(False).alias("lead"))
        lead = moved.select(*_GROUP, no_id, F.explode("log").alias("us"), F.lit(True).alias("lead"))
        rounds.append(stored(_fold(again.unionByName(lead), limit, window), "limits"))
        latest = cut_lineage(latest.unionByName(moved.select(*_GROUP, F.lit(len(rounds) - 1).alias("round"))))
        used = cut_lineage(used.join(moved.select(*_GROUP), [*_GROUP], "left_anti").unionByName(moved))
        fresh = logs(rounds[-1]).join(used.withColumnRenamed("log", "_used"), [*_GROUP])
        moved = cut_lineage(fresh.filter(F.col("log") != F.col("_used")).drop("_used"))
    last = latest.groupBy(*_GROUP).agg(F.max("round").alias("round"))
    every = None
    for k, found in enumerate(rounds):
        own = found.filter("not tail").join(last.filter(F.col("round") == k).select(*_GROUP), [*_GROUP], "left_semi")
        every = own if every is None else every.unionByName(own)
    return _decisions(every)


def _decisions(folded: DataFrame) -> DataFrame:
    return folded.filter("not tail").select("key", "id", "us", (F.col("retry_us") == 0).alias("allowed"), "retry_us")


class _Limiter(StatefulProcessor):
    """Requests wait in a list until the watermark has passed them, then are folded in order of time.

    State of a key: the waiting requests, the log of accepted times, and a timer at the earliest of both's ends.
    """

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, id bigint")
        self.log = handle.getListState("log", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = [(r["us"], r["id"]) for r in rows if r["id"] is not None]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [r for r in rows if r[0] > passed]
        if fresh:
            known = min(self.handle.listTimers(), default=None)
            self.waiting.appendList(fresh)
            first = min(fresh)[0] // 1000
            if known is None or first < known:
                self._ring(first, known)
        return iter([Row(key=key[0], id=ident, us=us, allowed=None, retry_us=None) for us, ident in rows if us <= passed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, log = [r for r in rows if r[0] <= passed], deque(t for (t,) in self.log.get())
        out = []
        for us, ident in due:
            wait = admit(us, log, self.limit, self.window)
            out.append(Row(key=key[0], id=ident, us=us, allowed=wait == 0, retry_us=wait))
        rest = rows[len(due) :]
        while log and log[0] <= passed - self.window:
            log.popleft()
        for state, left in ((self.waiting, rest), (self.log, [(t,) for t in log])):
            state.put(left) if left else state.clear()
        # The next request waiting, or the moment when the log is empty.
        if rest or log:
            self._ring((rest[0][0] if rest else log[-1] + self.window) // 1000 + (not rest), None)
        return iter(out)

    def _ring(self, at: int, known: int | None) -> None:
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISION = "key bigint, id bigint, us bigint, allowed boolean, retry_us bigint"


def stream_limits(requests: DataFrame, limit: int, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """The same rule on a stream of requests(key, ts, id), whatever order they come in up to ``lateness``.

    A request is decided once the watermark has passed it, so files in any order give the decisions of the sorted table.
    Requests behind the watermark are not decided: those that only this batch finds behind it come out with a null
    ``allowed``, those far behind are counted as rows dropped by the watermark in the query's progress. A key without requests or accepted times in reach has no state.
    The query needs the RocksDB state store (``ROCKS``). Rows without id only move the watermark.
    """
    window = seconds * 1_000_000
    timed = requests.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()).select(F.col("key").cast("bigint"), F.col("id").cast("bigint"), F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithState(_Limiter(limit, window), DECISION, "Append", "EventTime")


def drain_limits(requests: DataFrame, limit: int, seconds: int, lateness: str = "1 hour") -> tuple[DataFrame, int]:
    """Decisions on a stream of requests up to its current end, and how many requests came too late for one.

    Runs the stream over what there is, then moves the watermark past the last request by a row without id, so
    that nothing is left waiting.
    """
    from lectern.streaming.flow import work_path

    spark = requests.sparkSession
    beats, out, mark = (work_path(spark, name) for name in ("beats", "limits", "limits-mark"))
    schema = "key bigint, ts timestamp, id bigint"
    spark.createDataFrame([], schema).write.parquet(beats)
    own = requests.select(F.col("key").cast("bigint").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("bigint").alias("id"))
    decided = stream_limits(own.unionByName(spark.readStream.schema(schema).parquet(beats)), limit, seconds, lateness)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        late, last = 0, None
        for beat in (False, True):
            if beat:
                if last is None:
                    break
                after = F.lit(last).cast("timestamp") + F.expr(f"INTERVAL {lateness}") + F.expr(f"INTERVAL {seconds + 1} SECONDS")
                spark.range(1).select(F.lit(0).cast("bigint").alias("key"), after.alias("ts"), F.lit(None).cast("bigint").alias("id")).write.mode("append").parquet(beats)
            query = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
            query.awaitTermination()
            for p in query.recentProgress:
                late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
                last = max(filter(None, (last, p.eventTime.get("max"))), default=None)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.schema(DECISION).parquet(out)
    return found.filter(F.col("allowed").isNotNull()), late + found.filter(F.col("allowed").isNull()).count()


def late_requests(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requests of a table whose stream is drained that came behind the watermark: those without a decision."""
    timed = requests.filter(F.col("key").isNotNull() & F.col("ts").isNotNull())
    return timed.join(decisions.select("key", "id"), ["key", "id"], "left_anti")


def limit_events(decisions: DataFrame) -> DataFrame:
    """Audit rows for denied requests."""
    return decisions.filter(~F.col("allowed")).select(
        F.col("id").alias("event_id"), F.lit("rate_limit.hit").alias("action"), F.col("key").alias("actor_id"), "retry_us"
    )


def log_cleanup(decisions: DataFrame, now_us: int | None = None, seconds: int = 900) -> DataFrame:
    """Accepted timestamps still inside the longest window at ``now`` (default: each key's last request)."""
    kept = decisions.filter("allowed")
    if now_us is not None:
        return kept.filter(F.col("us") > now_us - seconds * 1_000_000).select("key", "us")
    last = decisions.groupBy("key").agg(F.max("us").alias("_now"))
    return kept.join(last, "key").filter(F.col("us") > F.col("_now") - seconds * 1_000_000).select("key", "us")
