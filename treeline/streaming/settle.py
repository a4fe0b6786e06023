"""Debounced search queries and settled trees: stateful stream processors and batch twins.

A typed query settles after ``IDLE_QUERY`` seconds without input.  Queries of
which one is a prefix of the other merge into the longest; another word emits
what stood before it.  A query equal to the last emitted one is dropped.  A tree
settles after ``IDLE_TREE`` seconds; the last value wins, and trees of fewer than
two keys are not heard.

The processors keep what arrives in a list state and take it up in the order of
event time, as far as the watermark has passed, so rows that arrive out of order
within it settle as the batch twin says.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import set_key

#: Idle gaps in seconds, least query length, watermark.
IDLE_QUERY, IDLE_TREE, LEAST, LATE = 1.5, 2.0, 2, "15 seconds"


def settling(rows: Iterator[tuple], idle: float = IDLE_QUERY) -> Iterator[tuple]:
    """rows (session, time, text), in order within each session that comes whole ->
    (session, time, query) of what each settles to."""
    session, standing, at, emitted = None, "", 0.0, ""

    def due() -> list[tuple]:
        nonlocal emitted
        if not standing or standing == emitted:
            return []
        emitted = standing
        return [(session, at, standing)]

    for own, t, text in rows:
        if own != session:
            yield from due()
            session, standing, emitted = own, "", ""
        text = text.strip()
        if len(text) < LEAST:
            continue
        if standing and (t - at > idle or not (text.startswith(standing) or standing.startswith(text))):
            yield from due()
            standing = text
        elif len(text) >= len(standing):
            standing = text
        at = t
    yield from due()


def settle_words(rows: list[tuple[float, str]], idle: float = IDLE_QUERY) -> list[tuple[float, str]]:
    """(time, query) of what one session's ordered input settles to."""
    return [(t, q) for _, t, q in settling(((0, t, text) for t, text in rows), idle)]


def settled_queries(events: DataFrame, idle: float = IDLE_QUERY) -> DataFrame:
    """Batch twin: (session, ts, query). A task reads whole sessions in order, a row
    at a time, so a session's length doesn't matter to its memory."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    heard = events.where("subject IS NOT NULL AND session IS NOT NULL").select("session", at, "subject").repartition("session").sortWithinPartitions("session", "at", "subject")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, t / 1e6, q) for f in frames for s, t, q in zip(f["session"], f["at"], f["subject"], strict=True))
        for part in cut(settling(rows, idle)):
            yield pd.DataFrame({"session": [x[0] for x in part], "ts": pd.to_datetime([round(x[1] * 1e6) for x in part], unit="us"), "query": [x[2] for x in part]})

    kind = events.schema["session"].dataType.simpleString()
    return heard.mapInPandas(run, f"session {kind}, ts timestamp_ntz, query string")


def cut(rows: Iterator, size: int = 10_000) -> Iterator[list]:
    """Lists of at most ``size`` rows."""
    while part := list(islice(rows, size)):
        yield part


def settled_trees(events: DataFrame, idle: float = IDLE_TREE) -> DataFrame:
    """Batch twin in plain windows: of the trees with two keys or more the last of
    each burst, where it differs from the one emitted before."""
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    heard = events.withColumn("key", set_key(F.split("tree", ","))).where(F.size(F.split("key", ",")) >= 2)
    e = heard.withColumn("next", F.lead("ts").over(w))
    last = e.where(F.col("next").isNull() | ((F.unix_micros(F.col("next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) > idle * 1_000_000))
    return last.withColumn("before", F.lag("key").over(w)).where("before IS NULL OR before <> key").select("session", "ts", "key", "cause")


class Settler(StatefulProcessor):
    """What stands (value, note, time) and was emitted last, what waits for the
    watermark, and one timer for the next of the two.  The standing value settles
    when the watermark has passed its time by more than ``idle``."""

    def __init__(self, idle: float, column: str):
        self.idle, self.column = idle, column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", "value string, note string, at double, emitted string")
        self.waiting = handle.getListState("waiting", "at double, value string, note string")

    def heard(self, row) -> tuple[str, str] | None:
        """(value, note) of an input row, None if it isn't heard."""
        raise NotImplementedError

    def merged(self, standing: str, value: str) -> str | None:
        """What stands after ``value``; None if ``standing`` is finished by it."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for g in rows:
            for r in g.itertuples():
                if (found := self.heard(r)) is not None:
                    self.waiting.appendValue((r.ts.timestamp(), *found))
        self._set_timer()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        value, note, at, emitted = self.standing.get() if self.standing.exists() else ("", "", 0.0, "")
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        out: list[tuple[float, str, str]] = []

        def emit() -> None:
            nonlocal emitted
            if value and value != emitted:
                out.append((at, value, note))
                emitted = value

        for t, new, new_note in [r for r in rows if r[0] < mark]:
            stays = self.merged(value, new) if value and t - at <= self.idle else None
            if stays is None:
                emit()
                stays = new
            value, note, at = stays, new_note, t
        if value and at + self.idle < mark:
            emit()
            value = ""
        self.standing.update((value, note, at, emitted))
        later = [r for r in rows if r[0] >= mark]
        self.waiting.put(later) if later else self.waiting.clear()
        self._set_timer()
        if out:
            yield pd.DataFrame({"session": [key[0]] * len(out), "ts": pd.to_datetime([round(x[0] * 1e6) for x in out], unit="us"), self.column: [x[1] for x in out], "note": [x[2] for x in out]})

    def _set_timer(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if self.standing.exists() and self.standing.get()[0]:
            due.append(self.standing.get()[2] + self.idle)
        if due:
            self.handle.registerTimer(int(min(due) * 1000) + 1)

    def close(self) -> None:
        pass


class QuerySettler(Settler):
    def __init__(self) -> None:
        super().__init__(IDLE_QUERY, "query")

    def heard(self, row):
        text = (row.subject or "").strip()
        return (text, "") if len(text) >= LEAST else None

    def merged(self, standing, value):
        if not (value.startswith(standing) or standing.startswith(value)):
            return None
        return value if len(value) >= len(standing) else standing


class TreeSettler(Settler):
    def __init__(self) -> None:
        super().__init__(IDLE_TREE, "key")

    def heard(self, row):
        keys = sorted(set((row.tree or "").split(",")))
        return (",".join(keys), row.cause or "") if len(keys) >= 2 else None

    def merged(self, standing, value):
        return value


def _settled(events: DataFrame, settler: Settler, note: str | None) -> DataFrame:
    kind = events.schema["session"].dataType.simpleString()
    marked = events.withWatermark("ts", LATE).groupBy("session")
    out = marked.transformWithStateInPandas(settler, f"session {kind}, ts timestamp, {settler.column} string, note string", "Append", "EventTime")
    return out.withColumnRenamed("note", note) if note else out.drop("note")


def stream_queries(events: DataFrame) -> DataFrame:
    """Settled queries of a stream (session, ts, subject); needs the RocksDB state store."""
    return _settled(events, QuerySettler(), None)


def stream_trees(events: DataFrame) -> DataFrame:
    """Settled trees (session, ts, key, cause) of a stream (session, ts, tree, cause)."""
    return _settled(events, TreeSettler(), "cause")


def stream_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a stream (or table) without session ids: by user, events less than ``gap`` apart."""
    return events.withWatermark("ts", LATE).groupBy("user", F.session_window("ts", gap)).agg(F.count("*").alias("events")).select("user", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def windowed(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Weight per kind in tumbling windows with late rows dropped by the watermark."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", length), "kind").agg(F.sum("weight").alias("weighted"))
