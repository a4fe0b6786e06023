"""Beacon ingestion: validation of posted batches, and the dual sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .settle import cut

#: Kinds, and caps of a batch and of its fields.
KINDS = ("search", "add", "tree")
BODY, EVENTS, SUBJECT, TREE, CAUSE, SESSION = 8192, 32, 128, 1024, 16, 64
SHAPE = "session string, events array<struct<kind:string,subject:string,tree:string,cause:string>>"


def validated(posts: DataFrame) -> DataFrame:
    """posts (body, ts) -> events; oversized, malformed and unknown ones go silently."""
    parsed = posts.where(F.octet_length("body") <= BODY).select("ts", F.from_json("body", SHAPE).alias("b")).where("b.session IS NOT NULL")
    each = parsed.select("ts", F.left("b.session", F.lit(SESSION)).alias("session"), F.explode(F.slice("b.events", 1, EVENTS)).alias("e")).where(F.col("e.kind").isin(*KINDS))
    tree = F.left("e.tree", F.lit(TREE))
    return each.select(
        "ts", "session", F.col("e.kind").alias("kind"), F.left("e.subject", F.lit(SUBJECT)).alias("subject"), tree.alias("tree"), F.left("e.cause", F.lit(CAUSE)).alias("cause"),
        F.when(F.coalesce(tree, F.lit("")) == "", 0).otherwise(F.size(F.split(tree, ","))).cast("long").alias("size"),
    )


def dual_sink(events: DataFrame, table: str, log: str, checkpoint: str):
    """One stream, two sinks written from the same micro-batch: columns and lines."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")  # a repeated batch replaces itself
        batch.select(F.to_json(F.struct(*batch.columns)).alias("value")).write.mode("overwrite").text(f"{log}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


#: Events of a posted batch, seconds after its first event.
POSTED, WAIT = 32, 3.0


def batching(rows, most: int = POSTED, wait: float = WAIT):
    """rows (session, time, ...), in order within each session that comes whole ->
    (burst, batch) of each: a batch goes out with its ``most``-th event, or ``wait``
    seconds after its first; a pause longer than that starts a burst."""
    session, last, first, held, burst, number = None, 0.0, 0.0, 0, 0, 0
    for own, t, *_ in rows:
        if own != session:
            session, burst, number, first, held = own, 1, 0, t, 0
        elif t - last > wait:
            burst, number, first, held = burst + 1, 0, t, 0
        elif held >= most or t - first > wait:
            number, first, held = number + 1, t, 0
        held, last = held + 1, t
        yield burst, number


def batches(times: list[float], most: int = POSTED, wait: float = WAIT) -> list[int]:
    """Number of the batch of each of a session's ordered events."""
    keys = list(batching(((0, t) for t in times), most, wait))
    order = {k: n for n, k in enumerate(dict.fromkeys(keys))}
    return [order[k] for k in keys]


def posted(events: DataFrame, most: int = POSTED, wait: float = WAIT) -> DataFrame:
    """(session, event_id, burst, batch): what is posted together. A task reads whole
    sessions in order, a row at a time."""
    import pandas as pd

    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = events.where("session IS NOT NULL").select("session", at, "event_id").repartition("session").sortWithinPartitions("session", "at", "event_id")

    def run(frames):
        ids: list = []

        def each():
            for f in frames:
                for s, t, e in zip(f["session"], f["at"], f["event_id"], strict=True):
                    ids.append((s, e))
                    yield s, t / 1e6

        for part in cut(batching(each(), most, wait)):
            told, ids[:] = ids[: len(part)], ids[len(part) :]
            yield pd.DataFrame({"session": [x[0] for x in told], "event_id": [x[1] for x in told], "burst": [x[0] for x in part], "batch": [x[1] for x in part]})

    kind = events.schema["session"].dataType.simpleString()
    return rows.mapInPandas(run, f"session {kind}, event_id long, burst long, batch long")


def last_cause(changes: DataFrame) -> DataFrame:
    """Each change with the cause of the last mutator up to it."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("cause", F.last("cause", ignorenulls=True).over(w))


def release_plan(queue: DataFrame, seconds: float) -> DataFrame:
    """(session, key, release): first-in-first-out draw queue; each repeat of a
    queued key is dropped and draws are ``seconds`` apart at least."""
    from pyspark.sql import Window

    first = queue.groupBy("session", "key").agg(F.min("ts").alias("ts"))
    w = Window.partitionBy("session").orderBy("ts", "key")
    n = first.withColumn("n", F.row_number().over(w) - 1)
    slack = F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.col("n") * seconds).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.select("session", "key", F.round(slack + F.col("n") * seconds, 6).alias("release"))


class DrawQueue:
    """First in, first out: the head is drawn once its data has arrived and nothing
    is being drawn; an interruption draws all that waits at once."""

    def __init__(self, queue=(), arrived=(), drawing: bool = False):
        self.queue, self.arrived, self.drawing = list(queue), set(arrived), drawing

    def hear(self, kind: str, key: str | None) -> list[str]:
        """Keys released by 'ask' or 'arrive' of a key, 'done', or 'flush'."""
        if kind == "ask" and key not in self.queue:
            self.queue.append(key)
        elif kind == "arrive":
            self.arrived.add(key)
        elif kind == "done":
            self.drawing = False
        elif kind == "flush":
            out, self.queue, self.drawing = self.queue, [], False
            return out
        if self.queue and not self.drawing and self.queue[0] in self.arrived:
            self.drawing = True
            return [self.queue.pop(0)]
        return []


def plan(keys: list[str], reduced: bool = False) -> tuple[list[str], list[str]]:
    """Keys drawn with the opening and those that queue: the first alone, unless
    motion is reduced or there are fewer than two."""
    return (list(keys), []) if reduced or len(keys) < 2 else (keys[:1], keys[1:])


class QueueProcessor(StatefulProcessor):
    """The stream form: rows (session, ts, n, kind, key) wait for the watermark and
    are heard in order; the queue, what arrived and whether something is drawn are
    one value state."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "queue array<string>, arrived array<string>, drawing boolean")
        self.waiting = handle.getListState("waiting", "at double, n long, kind string, key string")

    def handleInputRows(self, key, rows, timerValues):
        for g in rows:
            for r in g.itertuples():
                self.waiting.appendValue((r.ts.timestamp(), int(r.n), r.kind, r.key))
        self._set_timer()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs() / 1000
        queue = DrawQueue(*self.state.get()) if self.state.exists() else DrawQueue()
        rows = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        out = [(r[0], k) for r in rows if r[0] < mark for k in queue.hear(r[2], r[3])]
        self.state.update((queue.queue, sorted(queue.arrived), queue.drawing))
        later = [r for r in rows if r[0] >= mark]
        self.waiting.put(later) if later else self.waiting.clear()
        self._set_timer()
        if out:
            yield pd.DataFrame({"session": [key[0]] * len(out), "ts": pd.to_datetime([round(t * 1e6) for t, _ in out], unit="us"), "key": [k for _, k in out]})

    def _set_timer(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if due:
            self.handle.registerTimer(int(min(due) * 1000) + 1)

    def close(self) -> None:
        pass


def stream_draws(events: DataFrame, late: str = "15 seconds") -> DataFrame:
    """Released keys of a stream of queue events; needs the RocksDB state store."""
    kind = events.schema["session"].dataType.simpleString()
    return events.withWatermark("ts", late).groupBy("session").transformWithStateInPandas(QueueProcessor(), f"session {kind}, ts timestamp, key string", "Append", "EventTime")
