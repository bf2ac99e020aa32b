"""Event windows, incremental indexing and run states, in batch and streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.retrieval import missing
from ..sources import files
from ..sources.logs import Trace


def stamped(events: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP: a watermark takes no TIMESTAMP_NTZ."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = stamped(events)
    rows = rows if late is None else rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = stamped(events)
    rows = rows if late is None else rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def index_new(stream: DataFrame, target: str, checkpoint: str, key: str = "doc_id"):
    """Appends each micro-batch's rows whose key the target does not hold yet; restartable by its checkpoint."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).parquet(target).select(key) if files.exists(spark, target) else batch.select(key).limit(0)
        missing(batch.dropDuplicates([key]), known, key).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_state(updates: DataFrame, thread: str = "user_id", key: str = "event_type", value: str = "value", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last value of every key of a thread; in a stream in complete or update mode."""
    return updates.groupBy(thread, key).agg(F.max_by(value, F.struct(*order)).alias(value))


class Progress(StreamingQueryListener):
    """Notes the progress and the end of streams in a trace."""

    def __init__(self, trace: Trace):
        self.trace = trace

    def onQueryStarted(self, event) -> None:
        self.trace.note(str(event.runId), "stream", "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.trace.note(str(p.runId), "stream", "progress", input=str(p.batchId), score=float(p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.trace.note(str(event.runId), "stream", "ended", level="ERROR" if event.exception else None, output=event.exception)


# What each event does to a run in each state.
MOVES = {("queued", "view"): "running", ("running", "click"): "needs_confirmation", ("needs_confirmation", "signup"): "running", ("running", "purchase"): "done", ("running", "error"): "failed", ("queued", "error"): "failed"}


WAITING = "ts timestamp, event_id long, event_type string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Runs(StatefulProcessor):
    """A run's state, moved by its events in the order of their time, whatever order they arrive in.

    Events wait in a list until the watermark has passed them, since an earlier one may still come; a timer at the
    earliest waiting event wakes the run. forget_ms: a run that had no event for so long is given up and forgotten; a
    later event of its key begins a new run.
    """

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, seen long, last_ms long")
        self.waiting = handle.getListState("waiting", WAITING)

    def _wake(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            got = list(batch[["ts", "event_id", "event_type"]].itertuples(index=False, name=None))
            self.waiting.appendList([(ts.to_pydatetime(), int(n), kind) for ts, n, kind in got])
            least = min(_ms(ts) for ts, _, _ in got)
            first = least if first is None else min(first, least)
        timers = [*self.handle.listTimers()]
        if first is not None and (not timers or first < min(timers)):
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        status, seen, last = self.state.get() if self.state.exists() else ("queued", 0, 0)
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in held if _ms(e[0]) <= now]
        rest = held[len(due) :]
        for ts, _, kind in due:
            if self._over(last, _ms(ts)):
                status, seen = "queued", 0
            status, seen, last = MOVES.get((status, kind), status), seen + 1, _ms(ts)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        over = not due and self._over(last, now)
        if over:
            self.state.clear()
        else:
            self.state.update((status, seen, last))
        wake = [_ms(rest[0][0])] if rest else []
        if self.forget_ms is not None and not over:
            wake.append(max(last + self.forget_ms, now) + 1)
        if wake:
            self._wake(min(wake))
        if due or over:
            yield pd.DataFrame({"user_id": [key[0]], "status": ["forgotten" if over else status], "seen": [seen]})

    def _over(self, last_ms: int, now_ms: int) -> bool:
        return self.forget_ms is not None and last_ms > 0 and now_ms - last_ms > self.forget_ms


def _ms(ts) -> int:
    return -(-int(pd.Timestamp(ts).value) // 1_000_000)  # rounded up: an event is due when the watermark has reached all of it


def run_states(events: DataFrame, late: str = "1 hour", forget_ms: int | None = None) -> DataFrame:
    """Keyed state machine of runs: a row for a key whenever its events have moved it.

    Events that arrive within `late` of the newest are applied in order; the result is then that of run_states_batch.
    The session keeps such states in RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = stamped(events).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Runs(forget_ms), "user_id long, status string, seen long", "Update", "EventTime")


def run_states_batch(events: DataFrame) -> DataFrame:
    """The states after all events, as an ordered fold."""
    moves = F.create_map(*(F.lit(x) for (a, b), c in MOVES.items() for x in (f"{a}/{b}", c)))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"])
    folded = F.aggregate("kinds", F.lit("queued"), lambda s, k: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("/"), k)), s))
    return events.groupBy("user_id").agg(kinds.alias("kinds")).select("user_id", folded.alias("status"), F.size("kinds").cast("long").alias("seen"))
