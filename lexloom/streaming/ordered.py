"""Live pairing of lines that arrive out of order: they wait in the state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MS = 1000
#: Groups that logs are dealt out to; a group is one call and one entry of the state, whatever logs it holds.
GROUPS = 2048
#: Kinds of lines as they are kept, and lines of one entry of a list in the state.
KINDS, LINES_AT_ONCE = ("start", "done", "fail"), 1 << 16
_NONE, _KEY, _AT, _ID, _KIND = range(5)


def _packed(lines: np.ndarray) -> bytes:
    return np.ascontiguousarray(lines, np.int64).tobytes()


def _lines(held: bytes) -> np.ndarray:
    return np.frombuffer(held, np.int64).reshape(-1, 5)


class _Pairing(StatefulProcessor):
    """State of a group of logs: the pending start of each (a value) and the lines that may still be preceded by late
    ones (a list), both as rows of whether the log's key is null, the key, microseconds, id and kind."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "lines binary")
        self.waiting = handle.getListState("waiting", "lines binary")

    def _pending(self) -> np.ndarray:
        return _lines(bytes(self.pending.get()[0])) if self.pending.exists() else np.zeros((0, 5), np.int64)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        given = np.concatenate([self._pending(), _rows(initialState)])
        self._hold(_last(given[np.lexsort(given.T[[_ID, _AT, _KEY, _NONE]])]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self._wait(_rows(part))
        yield from self._release(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(timerValues.getCurrentWatermarkInMs())

    def _wait(self, lines: np.ndarray) -> None:
        if len(lines):
            self.waiting.appendList([(_packed(lines[i : i + LINES_AT_ONCE]),) for i in range(0, len(lines), LINES_AT_ONCE)])

    def _hold(self, starts: np.ndarray) -> None:
        if len(starts):
            self.pending.update((_packed(starts),))
            self.handle.registerTimer(int(starts[:, _AT].min()) // _MS + self.idle_ms)
        elif self.pending.exists():
            self.pending.clear()

    def _release(self, watermark: int) -> Iterator[pd.DataFrame]:
        lines = np.concatenate([np.zeros((0, 5), np.int64), *(_lines(bytes(x[0])) for x in self.waiting.get())])
        passed = lines[:, _AT] // _MS <= watermark
        ready, left = lines[passed], lines[~passed]
        if len(ready):
            self.waiting.clear()
            self._wait(left)
        if len(left):
            self.handle.registerTimer(int(left[:, _AT].min()) // _MS)  # it fires when the watermark has passed the next line
        before = self._pending()
        known = np.concatenate([before, ready])
        fresh = np.arange(len(known)) >= len(before)  # a pending start stands before its log's lines
        known = known[np.lexsort((known[:, _ID], known[:, _AT], fresh, known[:, _KEY], known[:, _NONE]))]
        starts = _last(known)
        starts = starts[starts[:, _AT] // _MS + self.idle_ms > watermark]
        if len(ready) or len(starts) < len(before):
            self._hold(starts)
        at = np.flatnonzero(_same_log(known) & (known[:-1, _KIND] == 0) & (known[1:, _KIND] > 0))
        if len(at):
            start, end = known[at], known[at + 1]
            keys = pd.array(end[:, _KEY], "Int64")
            keys[end[:, _NONE] > 0] = pd.NA
            yield pd.DataFrame({"key": keys, "start_id": start[:, _ID], "end_id": end[:, _ID], "status": np.where(end[:, _KIND] == 1, "completed", "failed")})

    def close(self) -> None:
        pass


def _rows(part: pd.DataFrame) -> np.ndarray:
    return part[["none", "key", "at", "id", "kind"]].to_numpy(np.int64)


def _same_log(lines: np.ndarray) -> np.ndarray:
    return (lines[1:, :_AT] == lines[:-1, :_AT]).all(1)


def _last(lines: np.ndarray) -> np.ndarray:
    """The last line of each log in sorted lines, where that is a start."""
    ends = np.concatenate([~_same_log(lines), [True]]) if len(lines) else np.zeros(0, bool)
    return lines[ends & (lines[:, _KIND] == 0)]


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which pair_ordered() needs; afterwards the session's
    store is as before."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(SETTING, before) if before else spark.conf.unset(SETTING)


def pending_starts(events: DataFrame) -> DataFrame:
    """key, id, ts of each log's last line if that is a start: what a batch leaves pending for a stream to go on with."""
    kept = events.where(F.col("kind").isin("start", "done", "fail"))
    last = kept.groupBy("key").agg(F.max_by(F.struct("id", "ts", "kind"), F.struct("ts", "id")).alias("l"))
    return last.where("l.kind = 'start'").select("key", "l.id", "l.ts")


def _dealt(lines: DataFrame, groups: int) -> DataFrame:
    """Lines as numbers, with the group of their log."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    return lines.select(
        F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group"), F.col("key").isNull().cast("long").alias("none"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("key"),
        "ts", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), kind.cast("long").alias("kind"),
    )


def pair_ordered(events: DataFrame, idle: str = "1 day", late: str = "2 hours", initial: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """Ends right after a start, log by log, as the batch pairing gives them: key, ts, id, kind in; key, start_id,
    end_id, status out.

    Lines may arrive up to `late` out of order, within a batch and across batches: they wait in the state until the
    watermark has passed them, and are then taken in the order of time and id. So a pair is given `late` after its
    end; lines that come later than that are dropped, and so are lines without a time. A start without an end goes when
    the watermark is `idle` past it. initial: starts that are pending when the stream begins (see pending_starts()).
    Logs are dealt out to `groups` by their key, which stays as it is for a checkpoint: calls and entries of the state
    grow with the groups, not with the logs. Start it inside rocksdb().
    """
    kept = events.where(F.col("kind").isin(*KINDS) & F.col("ts").isNotNull()).withWatermark("ts", late)
    begin = _dealt(initial.select("key", "id", "ts", F.lit(KINDS[0]).alias("kind")), groups).groupBy("group") if initial is not None else None
    idle_ms = int(pd.Timedelta(idle).total_seconds() * _MS)
    return _dealt(kept, groups).groupBy("group").transformWithStateInPandas(_Pairing(idle_ms), "key bigint, start_id bigint, end_id bigint, status string", "append", "eventTime", begin)
