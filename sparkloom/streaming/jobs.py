"""Structured Streaming: windowed counts, last values with expiry, message reassembly."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Characters that a flow may hold back for an end mark; beyond that they are given out as a part.
LONGEST_TAIL = 1_000_000


def windowed(stream: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """window_start, keys, n, of a stream whose rows come at most so late."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """begin, end, keys, n of sessions that a gap ends; end is the last row's time plus the gap."""
    counts = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *keys, "n")


def messages(stream: DataFrame, keys: dict[str, str], order: str, text: str, end: str, longest: int = LONGEST_TAIL) -> DataFrame:
    """keys, message, complete: a flow's texts one after the other, cut behind every end mark; what is left waits for more.

    Rows of one micro-batch are put in order; batches follow each other as they come, so a
    source must give a flow's rows in order over batches. Of a flow that waits for an end mark
    with more than ``longest`` characters these are given out as a part (complete is false),
    and what comes next goes on from there: nothing is lost.
    """

    def cut(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        whole = (state.get[0] if state.exists else "") + "".join(rows[text].dropna())
        *done, tail = whole.split(end)
        out = [(m + end, True) for m in done]
        if len(tail) > longest:
            keep = len(end) - 1  # an end mark may be half there
            out.append((tail[: len(tail) - keep], False))
            tail = tail[len(tail) - keep :]
        state.update((tail,))
        if out:
            yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(keys, key)}, "message": [m for m, _ in out], "complete": [c for _, c in out]})

    schema = ", ".join(f"{k} {v}" for k, v in keys.items()) + ", message string, complete boolean"
    return stream.groupBy(*keys).applyInPandasWithState(cut, schema, "tail string", "append", GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Within it queries start with the state store that timers need; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class _Idle(StatefulProcessor):
    """A key's open sessions: intervals that are joined where rows come between them; a timer waits for the first of them to end."""

    def __init__(self, at: str, keys: list[str], gap: int) -> None:
        self.at, self.keys, self.gap = at, keys, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "begin long, last long, n long")

    def due(self, last: int) -> int:
        """When a session ends, in milliseconds: rows up to the gap behind its last belong to it."""
        return (last + self.gap) // 1000 + 1

    def first_due(self, known: list) -> int | None:
        """The one time for which a key with these sessions has a timer."""
        return min((self.due(x[1]) for x in known), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = [tuple(map(int, x)) for x in self.open.get()]
        joined: list[list[int]] = []
        for begin, last, n in sorted(before + [(r[self.at], r[self.at], 1) for r in rows]):
            if joined and begin - joined[-1][1] <= self.gap:
                joined[-1] = [joined[-1][0], max(joined[-1][1], last), joined[-1][2] + n]
            else:
                joined.append([begin, last, n])
        old, due = self.first_due(before), self.first_due(joined)
        if old != due:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
        self.open.put([tuple(x) for x in joined])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = [tuple(map(int, x)) for x in self.open.get()]
        # time may have passed the ends of more sessions than the first, and no row that could join them comes any more
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left = [x for x in known if self.due(x[1]) > now]
        if left:
            self.open.put(left)
            self.handle.registerTimer(self.first_due(left))
        else:
            self.open.clear()
        row = Row(*self.keys, "begin", "last", "n")
        return iter([row(*key, *x) for x in known if self.due(x[1]) <= now])

    def close(self) -> None:
        pass


def closed_when_idle(stream: DataFrame, at: str, keys: dict[str, str], gap: int, late: str) -> DataFrame:
    """keys, begin, end, n of each key's sessions, given out once a key has been idle for ``gap`` seconds; end is the last row's time.

    The state of a key is its open sessions, three numbers each, and goes when the last of them is
    closed; a key has one timer, whatever the number of its sessions. Rows may come in any order if
    they are at most so late; later ones are left out by the watermark. What is still open when a
    stream ends stays in the state. Queries need the store that timers() sets.
    """
    schema = ", ".join(f"{k} {v}" for k, v in keys.items()) + ", begin long, last long, n long"
    rows = stream.select(at, *keys).withWatermark(at, late).withColumn("__micros", F.unix_micros(at)).groupBy(*keys)
    found = rows.transformWithState(_Idle("__micros", list(keys), gap * 1_000_000), schema, "append", "eventTime")
    return found.select(*keys, F.timestamp_micros("begin").alias("begin"), F.timestamp_micros("last").alias("end"), "n")


def run_once(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """What is there now, as one run of a query into a Parquet folder; complete results replace what the folder has.

    Rows that are appended go to Spark's own sink of files, whose log has each batch once: a batch
    that is run again after a failure doubles no row. Without a checkpoint folder one beside path is taken.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or path.rstrip("/") + ".state")
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
