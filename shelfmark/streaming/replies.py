"""Replies as streams of tagged NDJSON lines, and their accumulation: in batches, and with state as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from shelfmark.functions.text import word_stream

# Kinds of lines, in their order, and the phases of a message.
KINDS = ("metadata", "content", "error", "done")
LINE = "request_id string, seq int, type string, delta string, message string, sources string, is_triage boolean"
MESSAGE = "request_id string, content string, sources string, phase string, error string, complete boolean, is_triage boolean"
#: What a session that runs ``accumulated`` as a stream sets.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STOPPED = "Generation stopped."
#: A message without a new line for so long ends as it is.
TIMEOUT_MS = 60_000
#: An ended request is known for so long, so that a line sent again opens no new message.
REMEMBER_MS = 600_000


def reply_lines(replies: DataFrame, key: str = "request_id", reply: str = "reply", sources: str | None = None, triage: str | None = None) -> DataFrame:
    """The lines of a whole reply: metadata (with the flag of a triage reply), a delta for each word, done. ``seq`` orders
    a request's lines."""

    def line(kind: str, delta: Column | None = None, listed: Column | None = None, flag: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(kind).alias("type"), (none if delta is None else delta).cast("string").alias("delta"), (none if listed is None else listed).cast("string").alias("sources"), (none if flag is None else flag).cast("boolean").alias("is_triage"))

    meta = line("metadata", None, F.col(sources) if sources else None, F.col(triage) if triage else F.lit(False))
    words = F.transform(word_stream(F.col(reply)), lambda w: line("content", w))
    lines = replies.select(F.col(key).cast("string").alias("request_id"), F.posexplode(F.concat(F.array(meta), words, F.array(line("done")))).alias("seq", "line"))
    return lines.select("request_id", "seq", "line.type", "line.delta", F.lit(None).cast("string").alias("message"), "line.sources", "line.is_triage")


def useful(lines: DataFrame) -> DataFrame:
    """Lines without empty deltas."""
    return lines.where((F.col("type") != "content") | (F.length("delta") > 0))


def assembled(lines: DataFrame) -> DataFrame:
    """One message for each request, from lines in any order: deltas joined by seq, sources of the metadata, phase.

    Of lines with one seq the least counts, once; lines after ``done`` don't. A triage reply has no sources to read, and is
    generated from its metadata on.
    """
    fields = ["type", "delta", "message", "sources", "is_triage"]
    missing = {"is_triage": F.lit(False)} if "is_triage" not in lines.columns else {}
    once = lines.withColumns(missing).groupBy("request_id", "seq").agg(F.min(F.struct(*fields)).alias("l")).select("request_id", "seq", "l.*")
    last = once.groupBy("request_id").agg(F.min(F.when(F.col("type") == "done", F.col("seq"))).alias("__last"))
    counted = once.join(last, "request_id").where(F.col("__last").isNull() | (F.col("seq") <= F.col("__last")))
    is_meta = F.col("type") == "metadata"
    deltas = F.array_sort(F.collect_list(F.when(F.col("type") == "content", F.struct("seq", "delta"))))
    finished = F.bool_or(F.col("type") == "done")
    failed = F.max_by("message", F.when(F.col("type") == "error", F.col("seq")))
    triage = F.coalesce(F.bool_or(F.when(is_meta, F.col("is_triage"))), F.lit(False))
    phase = F.when(finished, "done").when(F.bool_or(F.col("type") == "content") | triage, "generating").when(F.bool_or(is_meta), "reading").otherwise("searching")
    return counted.groupBy("request_id").agg(
        F.array_join(F.transform(deltas, lambda d: d["delta"]), "").alias("content"), F.max_by("sources", F.when(is_meta, F.col("seq"))).alias("sources"),
        phase.alias("phase"), failed.alias("error"), finished.alias("complete"), triage.alias("is_triage"),
    )


def incomplete(lines: DataFrame) -> DataFrame:
    """Requests whose lines lack ``done``."""
    return lines.groupBy("request_id").agg(F.count_if(F.col("type") == "done").alias("n")).where("n = 0").select("request_id")


def stopped(messages: DataFrame) -> DataFrame:
    """Messages that ended early are closed; an empty one gets a fixed text."""
    content = F.when(F.col("complete"), F.col("content")).otherwise(F.coalesce(F.nullif("content", F.lit("")), F.lit(STOPPED)))
    return messages.withColumn("content", content).withColumn("phase", F.lit("done"))


class _Message(StatefulProcessor):
    """State of one request: what its message holds so far, lines that came before their turn, and, for a while after
    its end, that it ended.

    Lines take effect in the order of seq, from 0 on. One that comes before an earlier one waits; one that comes again is
    left out, and so is whatever comes after the end. A message ends with ``done``, once all lines before it are there, or
    with a minute of silence, as it is.
    """

    def __init__(self, timeout_ms: int, remember_ms: int):
        self.timeout_ms, self.remember_ms = timeout_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.message = handle.getValueState("message", "content string, sources string, phase string, error string, is_triage boolean, next_seq int")
        self.early = handle.getMapState("early", "seq int", "type string, delta string, message string, sources string, is_triage boolean")
        self.ended = handle.getValueState("ended", "ended boolean", ttlDurationMs=self.remember_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        # a call to the store is a round trip: a request without a message has nothing waiting and no timer
        held = self.message.get()
        found = held or ("", None, "searching", None, False, 0)
        waiting = dict(self._waiting()) if held else {}
        for frame in rows:
            for line in frame.itertuples(index=False):
                if line.seq >= found[5]:
                    waiting.setdefault(int(line.seq), tuple(None if pd.isna(x) else x for x in (line.type, line.delta, line.message, line.sources, line.is_triage)))
        found, done = _walked(found, waiting, False)
        if done:
            yield self._end(key, found, True, bool(held))
            return
        self.message.update(found)
        if held:
            self.early.clear()
            self._stop_timers()
        for seq, line in waiting.items():
            self.early.updateValue((seq,), line)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.message.exists():
            found, done = _walked(self.message.get(), dict(self._waiting()), True)
            yield self._end(key, found, done)

    def close(self) -> None:
        pass

    def _waiting(self) -> Iterator[tuple[int, tuple]]:
        for (seq,), line in self.early.iterator():
            yield seq, tuple(line)

    def _stop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def _end(self, key: tuple, found: tuple, complete: bool, held: bool = True) -> pd.DataFrame:
        if held:
            self.message.clear()
            self.early.clear()
            self._stop_timers()
        self.ended.update((True,))
        content, sources, _, error, triage, _ = found
        return pd.DataFrame([(key[0], content if complete else content or STOPPED, sources, "done", error, complete, triage)], columns=[c.split()[0] for c in MESSAGE.split(", ")])


def _walked(found: tuple, waiting: dict[int, tuple], over_gaps: bool) -> tuple[tuple, bool]:
    """A message after the lines whose turn it is, which leave ``waiting``; and whether it is done."""
    content, sources, phase, error, triage, at = found
    while at in waiting or (over_gaps and waiting):
        at = at if at in waiting else min(waiting)
        kind, delta, message, listed, flagged = waiting.pop(at)
        at += 1
        if kind == "done":
            return (content, sources, "done", error, triage, at), True
        if kind == "metadata":
            sources, triage = listed, bool(triage or flagged)
            phase = "generating" if triage else "reading"
        elif kind == "content":
            content, phase = content + (delta or ""), "generating"
        elif kind == "error":
            error = message
    return (content, sources, phase, error, triage, at), False


def accumulated(lines: DataFrame, timeout_ms: int = TIMEOUT_MS, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """Lines, as a stream or a table, as finished messages; each request has one, emitted on ``done`` or, in a stream,
    after a time of silence. What comes for it within ``remember_ms`` after that is left out. Lines need their own seq,
    without gaps: filter empty deltas (``useful``) after this, not before. State is kept in RocksDB (``STORE``)."""
    lines.sparkSession.streams.active  # noqa: B018  starts what keeps track of state, which a table needs as well
    return lines.groupBy("request_id").transformWithStateInPandas(_Message(timeout_ms, remember_ms), MESSAGE, "Append", "ProcessingTime")


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by event-time window, with a watermark; works on streams and on batches alike (an extension)."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def settled(events: DataFrame, key: str, at: str, value: str, gap: str = "350 milliseconds") -> DataFrame:
    """The last value of each burst: values that follow each other by less than ``gap`` count as one."""
    return events.withWatermark(at, gap).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at)).drop("w")
