"""Representations of steps: sliding inference with context, in blocks of arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Frames that one call of an encoder gets at most.
FRAMES = 4096

Encoder = Callable[[np.ndarray], np.ndarray]


def dilated_smoother(depth: int) -> Encoder:
    """An encoder without training: `depth` layers of the kernel 1/4, 1/2, 1/4 with dilations 1, 2, 4, ...; missing points count as 0,
    as does what lies beyond a frame."""

    def encode(x: np.ndarray) -> np.ndarray:
        out = np.nan_to_num(x)
        for layer in range(depth):
            d = 1 << layer
            wide = np.pad(out, ((0, 0), (d, d)))
            out = 0.25 * wide[:, : -2 * d] + 0.5 * out + 0.25 * wide[:, 2 * d :]
        return out

    return encode


def max_pooled(x: np.ndarray, k: int) -> np.ndarray:
    """Running maximum of k points along the second axis, k // 2 before; as windows.pooled(), within a frame."""
    before = k // 2
    wide = np.pad(x, ((0, 0), (before, k - 1 - before)), constant_values=-np.inf)
    return np.lib.stride_tricks.sliding_window_view(wide, k, axis=1).max(axis=-1)


def frames(df: DataFrame, series: list[str], length: int, padding: int, causal: bool = False, t: str = "t", value: str = "value") -> DataFrame:
    """series, block, first, x: for each block of `length` steps its own values and up to `padding` before it (and behind it, unless
    causal) as an array in order; first is the step of the first value.

    A row goes to its own block and to those whose context it is in by a generator, so a long series is dealt to many tasks and
    no task holds more of it than its frames; steps are 0, 1, ... without gaps."""
    behind = 0 if causal else padding
    last = F.floor((F.count("*").over(Window.partitionBy(*series)) - 1) / length)
    lo = F.greatest(F.lit(0), F.ceil((F.col(t) - length - behind + 1) / length))
    hi = F.least(F.floor((F.col(t) + padding) / length), F.col("_last"))
    out = df.select(*series, t, F.col(value).cast("double").alias("_v"), last.alias("_last"))
    out = out.withColumn("block", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    packs = out.groupBy(*series, "block").agg(F.sort_array(F.collect_list(F.struct(t, "_v"))).alias("_c"))  # length + 2 * padding steps
    return packs.select(*series, "block", F.col("_c")[0][t].alias("first"), F.transform("_c", lambda c: c["_v"]).alias("x"))


def sliding_encoded(df: DataFrame, series: list[str], length: int, padding: int, encode: Encoder, causal: bool = False, window: int | str | None = None, t: str = "t", value: str = "value") -> DataFrame:
    """series, t, value: what encode gives for each step from its block and the context around it; missing points are NaN in frames.

    encode maps an array (frames, steps) to one of the same shape, and sees frames of one length: length + padding, and padding
    behind unless causal. window pools the encoded frame before the context is cut off: a number is that many steps' running
    maximum; "series" gives one row for each series, the maximum over all its blocks' own steps."""
    packs = frames(df, series, length, padding, causal, t, value)
    wide = length + padding + (0 if causal else padding)
    kinds = T.StructType([packs.schema[k] for k in series] + [T.StructField(t, T.LongType()), T.StructField("value", T.DoubleType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, FRAMES):
                b = whole.slice(a, FRAMES)
                lists = b.column(b.schema.names.index("x"))
                sizes = np.diff(lists.offsets.to_numpy())
                begin = b.column(b.schema.names.index("block")).to_numpy() * length
                first = b.column(b.schema.names.index("first")).to_numpy()
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                row = np.repeat(np.arange(len(sizes)), sizes)
                column = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (first - begin + padding)[row]
                x = np.full((len(sizes), wide), np.nan)
                x[row, column] = values
                z = encode(x)
                if isinstance(window, int):
                    z = max_pooled(z, window)
                own = (column >= padding) & (column < padding + length)
                keys = [b.column(b.schema.names.index(k)).take(pa.array(row[own])) for k in series]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(begin[row[own]] + column[own] - padding, pa.int64()), pa.array(z[row[own], column[own]])], schema=arrow)

    out = packs.mapInArrow(run, kinds)
    return out.groupBy(*series).agg(F.max("value").alias("value")) if window == "series" else out
