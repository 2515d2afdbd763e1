"""Windows over an event stream that do not depend on the order in which rows arrive.

Rows wait in a list state until the watermark has passed them, and then go through their key's window in the order of their event
times. State is Spark's own (transformWithState), which asks for the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_WAITING = T.StructType([T.StructField("ms", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("value", T.DoubleType())])
_TAIL = T.StructType([T.StructField("seen", T.LongType()), T.StructField("held", T.ArrayType(T.DoubleType()))])


def full_windows(values: np.ndarray, seen: int, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, mean and maximum of the full windows of values, of which the first has number `seen`."""
    if len(values) < length:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    starts = np.arange(seen, seen + len(values) - length + 1)
    chosen = starts % stride == 0
    wide = np.lib.stride_tricks.sliding_window_view(values, length)[chosen]
    return starts[chosen], wide.mean(axis=1), wide.max(axis=1)


class InOrder(StatefulProcessor):
    """Windows of `length` values of each key, `stride` apart, over rows in the order of (time, tie)."""

    def __init__(self, key: str, time: str, tie: str, value: str, length: int, stride: int):
        self.key, self.time, self.tie, self.value, self.length, self.stride = key, time, tie, value, length, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.tail = handle.getValueState("tail", _TAIL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ms = pdf[self.time].astype("datetime64[us]").astype("int64") // 1000
            self.waiting.appendList([(int(m), int(t), float(v)) for m, t, v in zip(ms, pdf[self.tie], pdf[self.value])])
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def _released(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Windows that end in rows no later than the watermark, behind which no row comes any more; later rows go on waiting for a timer."""
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= watermark]
        later = rows[len(ready) :]
        if later:
            self.handle.registerTimer(later[0][0] + 1)
        if not ready:
            return
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        seen, held = self.tail.get() if self.tail.exists() else (0, [])
        values = np.array([*held, *(v for _, _, v in ready)], float)
        starts, mean, hi = full_windows(values, seen, self.length, self.stride)
        kept = min(len(values), self.length - 1)
        self.tail.update((int(seen + len(values) - kept), values[len(values) - kept :].tolist()))
        if len(starts):
            yield pd.DataFrame({self.key: key[0], "start": starts, "mean": mean, "hi": hi})


def event_windows(stream: DataFrame, key: str, time: str, tie: str, length: int, stride: int = 1, delay: str = "1 hour", value: str = "value") -> DataFrame:
    """key, start, mean, hi of each full window over rows in the order of their times (then tie), as count_windows() for rows in order.

    Rows later than the watermark, which trails the latest time by `delay`, are dropped by Spark; what the watermark has not
    passed when a stream stops waits in the state for the next run."""
    kinds = T.StructType([stream.schema[key], T.StructField("start", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    marked = stream.select(key, time, F.col(tie).cast("long").alias(tie), value).withWatermark(time, delay)
    return marked.groupBy(key).transformWithStateInPandas(InOrder(key, time, tie, value, length, stride), kinds, "append", "eventTime")
