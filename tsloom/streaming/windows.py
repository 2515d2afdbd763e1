"""Sliding windows by count over an event stream, with Structured Streaming state per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsloom.streaming.events import full_windows


def count_windows(stream: DataFrame, key: str, length: int, stride: int = 1, order: str = "t", value: str = "value") -> DataFrame:
    """key, start, mean, hi of each full window of `length` consecutive values; the state of a key is its last length - 1 values and the number of the first of them.

    Rows of one trigger are put in order; a row that comes in a later trigger counts as later."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        values = np.concatenate([np.asarray(held, float), pd.concat(list(frames)).sort_values(order)[value].to_numpy(float)])
        starts, mean, hi = full_windows(values, seen, length, stride)
        kept = min(len(values), length - 1)
        state.update((int(seen + len(values) - kept), values[len(values) - kept :].tolist()))
        yield pd.DataFrame({key: name[0], "start": starts, "mean": mean, "hi": hi})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, start long, mean double, hi double", "seen long, held array<double>", "append", GroupStateTimeout.NoTimeout)
