"""The change feed: debounced watching, debounced reloads, replay of a write queue. Each takes a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Silence that ends a burst of changes, and waits before a reload.
WATCH_GAP, TOUCHED_GAP, OTHER_GAP = "500 milliseconds", "800 milliseconds", "35 seconds"


def _at(changes: DataFrame, late: str) -> DataFrame:
    """A stream needs a watermark on a zoned time; a batch stays as it is."""
    if not changes.isStreaming:
        return changes
    return changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _keys(d: DataFrame, key: str | None) -> list[Column]:
    """A stream's sessions need a key; without one all rows have the same (which is no literal, or it would be dropped)."""
    return [F.col(key)] if key else [F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1)).alias("feed")] if d.isStreaming else []


def debounce(changes: DataFrame, gap: str | Column = WATCH_GAP, late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Bursts of changes (ts, path) parted by silence: start, end, n, paths (distinct). Sessions merge from
    partial ones on the map side, so a burst's rows need not meet before they are summed."""
    d = _at(changes, late)
    s = d.groupBy(F.session_window("ts", gap), *_keys(d, key)).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *([key] if key else []), "n", "paths")


def reload_gap(touched: Column, short: str = TOUCHED_GAP, long: str = OTHER_GAP) -> Column:
    return F.when(touched, F.lit(short)).otherwise(F.lit(long))


def reloads(pushes: DataFrame, short: str = TOUCHED_GAP, long: str = OTHER_GAP, late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Reloads that pushes (ts, touched) cause: each waits for a silence that depends on the push; a reload
    covers all pushes of its wait: start, end, n, touched."""
    d = _at(pushes, late)
    s = d.groupBy(F.session_window("ts", reload_gap(F.col("touched"), short, long)), *_keys(d, key)).agg(F.count("*").alias("n"), F.max("touched").alias("touched"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *([key] if key else []), "n", "touched")


def replay(queue: DataFrame, key: str = "path", queue_of: str | None = None) -> DataFrame:
    """What an ordered queue of writes (id, path, kind, ok) leaves, by key: items run in the order of id up to the
    first network error (kind 'network'), which stops the whole queue; a content error (ok false) drops its item.
    With `queue_of` each value of that column is a queue of its own.
    Gives key, applied, dropped, waiting, last_id. Aggregates with partial sums; no ordering in one place."""
    stop = queue.where("kind = 'network'")
    if queue_of is None:
        j = queue.crossJoin(F.broadcast(stop.agg(F.min("id").alias("stop"))))  # one row
    else:
        j = queue.join(stop.groupBy(queue_of).agg(F.min("id").alias("stop")), queue_of, "left")
    before = F.col("stop").isNull() | (F.col("id") < F.col("stop"))
    return j.groupBy(key).agg(
        F.count_if(before & F.col("ok")).alias("applied"), F.count_if(before & ~F.col("ok")).alias("dropped"),
        F.count_if(~before).alias("waiting"), F.max(F.when(before & F.col("ok"), F.col("id"))).alias("last_id"),
    )


class Replayer(StatefulProcessor):
    """Runs one queue: items wait in a buffer until all before them have come, then run in order. State: the
    next seq, whether the queue has stopped, and the items that came early, which is all that it holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, stopped boolean")
        self.early = handle.getMapState("early", "seq long", "id long, path string, kind string, ok boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, stopped = self.at.get() if self.at.exists() else (1, False)
        for part in rows:
            for seq, *item in part[["seq", "id", "path", "kind", "ok"]].itertuples(index=False, name=None):
                if seq >= at:  # else it has run: a source may send it again
                    self.early.updateValue((int(seq),), (int(item[0]), item[1], item[2], bool(item[3])))
        ran = []
        while self.early.containsKey((at,)):
            id_, path, kind, ok = self.early.getValue((at,))
            self.early.removeKey((at,))
            stopped = stopped or kind == "network"
            ran.append((str(key[0]), at, id_, path, "waiting" if stopped else "applied" if ok else "dropped"))
            at += 1
            if len(ran) == 10_000:
                yield pd.DataFrame(ran, columns=RAN)
                ran = []
        self.at.update((at, stopped))
        if ran:
            yield pd.DataFrame(ran, columns=RAN)

    def close(self) -> None:
        pass


RAN = ["queue", "seq", "id", "path", "outcome"]


def replay_stream(queue: DataFrame, queue_of: str = "queue") -> DataFrame:
    """The outcome (applied, dropped or waiting) of each item of a stream of queues, once, in the order of its seq.

    queue: a queue's name in the column `queue_of`, seq (1, 2, 3... in each queue), id, path, kind, ok; rows may
    come in any order and more than once. An item runs when all before it have come; the first network error of a queue
    stops that queue. Rows without a queue or seq do not run. Needs the RocksDB state store (`rocks`).
    """
    q = queue.where(F.col(queue_of).isNotNull() & (F.col("seq") >= 1))
    q = q.select(F.col(queue_of).cast("string").alias("queue"), F.col("seq").cast("long").alias("seq"), F.col("id").cast("long").alias("id"), "path", F.coalesce("kind", F.lit("write")).alias("kind"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return q.groupBy("queue").transformWithStateInPandas(Replayer(), "queue string, seq long, id long, path string, outcome string", "append", "none")


@contextmanager
def rocks(spark) -> Iterator[None]:
    """Streams of this session that start within keep their state in RocksDB, which `replay_stream` needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def outcomes(ran: DataFrame, key: str = "path") -> DataFrame:
    """What `replay` gives, of the outcomes of `replay_stream`: key, applied, dropped, waiting, last_id."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return ran.groupBy(key).agg(n("applied"), n("dropped"), n("waiting"), F.max(F.when(F.col("outcome") == "applied", F.col("id"))).alias("last_id"))


EVENT = "ts timestamp, kind string, path string, touched boolean"


def pushes(spark, folder: str, kinds: tuple[str, ...] = ("push",)) -> DataFrame:
    """A stream of the events (JSON lines of EVENT) that arrive in a folder; only pushes go on, malformed lines do not."""
    raw = spark.readStream.schema("value string").text(folder)
    e = raw.select(F.from_json("value", EVENT).alias("e")).select("e.*")
    return e.where(F.col("kind").isin(*kinds) & F.col("ts").isNotNull())


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream over what is there now into a table in the driver's memory; for short streams."""
    spark = stream.sparkSession
    w = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return spark.table(name)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Drive a stream over what is there now into a table in a folder, which tasks write: no row passes the driver."""
    run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def backoff(attempt: int, jitter: float = 0.0) -> float:
    """Seconds before the next try to connect."""
    return min(30.0, 2.0 ** min(attempt, 5)) + jitter
