"""Delay embedding, masks, spectra and positional embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tsloom.functions.hashing import uniform


def delay_columns(length: int, size: int, delay: int) -> list[tuple[int, int]]:
    """(first step, steps) of each column; a partial one at the end where the full ones' count times delay misses the length."""
    full = (length - size) // delay + 1
    out = [(i * delay, size) for i in range(full)]
    return out + ([(full * delay, length - full * delay)] if full * delay < length else [])


def delay_embedded(df: DataFrame, length: int, size: int, delay: int, t: str = "t") -> DataFrame:
    """Image cells of long series: column c holds `size` steps from c * delay, r counts within it. Each row goes to the columns it
    is in by a generator over a short list; rows beyond the partial column's end are its zero tail and not listed here."""
    cols = delay_columns(length, size, delay)
    if len(cols) > size:
        raise ValueError(f"{len(cols)} columns do not fit an image of {size}")
    places = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(a).alias("a"), F.lit(n).alias("n")) for c, (a, n) in enumerate(cols)])
    mine = F.filter(places, lambda p: (F.col(t) >= p["a"]) & (F.col(t) < p["a"] + p["n"]))
    out = df.withColumn("_p", F.explode(mine))
    return out.withColumns({"c": F.col("_p.c"), "r": (F.col(t) - F.col("_p.a")).cast("int")}).drop("_p", t)


def delay_inverse(cells: DataFrame, keys: list[str], delay: int) -> DataFrame:
    """Steps from cells; where columns overlap, the last one counts."""
    return cells.groupBy(*keys, (F.col("c") * delay + F.col("r")).cast("long").alias("t")).agg(F.max_by("value", "c").alias("value"))


def half_mask(t: Column, length: int) -> Column:
    """1 on the first half, 0 on the second."""
    return (t < length // 2).cast("int")


def random_mask(rate: float, *parts) -> Column:
    """1 where a point is kept: its uniform is at least the rate."""
    return (uniform(*parts) >= rate).cast("int")


def run_mask(t: Column, start: Column, length: int) -> Column:
    """0 on one run of missing points."""
    return (~t.between(start, start + length - 1)).cast("int")


def last_mask(t: Column, n: Column) -> Column:
    """0 on the last point."""
    return (t != n - 1).cast("int")


def runs_masked(df: DataFrame, series: list[str], count: int | float, length: int | float, seed: int, t: str = "t", name: str = "kept") -> DataFrame:
    """df with name 0 on the union of drawn runs of missing points, 1 elsewhere.

    count and length are numbers, or parts of a series' length n: max(1, min(count, n // 2)) runs of max(1, length) points, whose
    starts are uniform over those that fit. Each run is a mark up at its start and a mark down behind its end; a running total
    of marks over the series tells what lies in some run, without a join on ranges."""
    n = df.groupBy(*series).agg((F.max(t) + 1).alias("_n"))
    part = lambda x: F.floor(F.col("_n") * x) if isinstance(x, float) else F.lit(x)
    runs = n.withColumns({"_k": F.greatest(F.least(part(count), F.floor(F.col("_n") / 2)), F.lit(1)), "_l": F.least(F.greatest(part(length), F.lit(1)), F.col("_n"))})
    runs = runs.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k").cast("long") - 1)))
    start = F.floor(uniform(*[F.col(c) for c in series], F.col("_i"), seed) * (F.col("_n") - F.col("_l") + 1))
    marks = runs.withColumn("_s", start).select(*series, F.explode(F.array(F.struct(F.col("_s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("_s") + F.col("_l")).alias("at"), F.lit(-1).alias("d")))).alias("_m"))
    marks = marks.groupBy(*series, F.col("_m.at").cast(df.schema[t].dataType).alias(t)).agg(F.sum("_m.d").alias("_d"))
    line = Window.partitionBy(*series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(marks, [*series, t], "left")
    return out.withColumn(name, (F.sum(F.coalesce("_d", F.lit(0))).over(line) == 0).cast("int")).drop("_d")


def sinusoid(position: Column, width: int, scale: float = 10_000.0) -> Column:
    """Sines, then cosines, of the position at falling frequencies."""
    half = width // 2
    rates = [math.exp(-math.log(scale) * i / (half - 1)) for i in range(half)]
    return F.array(*[F.sin(position * r) for r in rates], *[F.cos(position * r) for r in rates])


def _same_length(batches, name: str):
    """(batch, array (rows, length)) of the rows of each batch, by length of their arrays."""
    for b in batches:
        lists = b.column(b.schema.names.index(name))
        sizes = np.diff(lists.offsets.to_numpy())
        for n in np.unique(sizes):
            part = b.take(pa.array(np.flatnonzero(sizes == n)))
            yield part, part.column(part.schema.names.index(name)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, n)


def _hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def stft(packs: DataFrame, keys: list[str], size: int, hop: int, name: str = "x") -> DataFrame:
    """keys, frame, f, re, im: one-sided spectra of Hann-windowed frames, reflected at the ends, of arrays longer than size // 2.

    All arrays of a batch that are of one length are one array, one transform, and four flat columns."""
    kinds = T.StructType([packs.schema[k] for k in keys] + [T.StructField(n, k) for n, k in (("frame", T.IntegerType()), ("f", T.IntegerType()), ("re", T.DoubleType()), ("im", T.DoubleType()))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])

    def run(batches):
        for b, x in _same_length(batches, name):
            p = np.pad(x, ((0, 0), (size // 2, size // 2)), mode="reflect")
            z = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(p, size, axis=1)[:, ::hop] * _hann(size), axis=2)
            rows, n, m = z.shape
            at = pa.array(np.repeat(np.arange(rows), n * m))
            places = [np.tile(np.repeat(np.arange(n, dtype=np.int32), m), rows), np.tile(np.arange(m, dtype=np.int32), rows * n)]
            columns = [b.column(b.schema.names.index(k)).take(at) for k in keys]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c) for c in (*places, z.real.ravel(), z.imag.ravel())], schema=arrow)

    return packs.select(*keys, name).mapInArrow(run, kinds)


def istft(cells: DataFrame, keys: list[str], size: int, hop: int, length: int, name: str = "x") -> DataFrame:
    """keys and the array of stft() by windowed overlap-add; a spectrum's cells are put together as one array of its size."""
    parts = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame", "f", "re", "im"))).alias("_c"))
    flat = parts.select(*keys, F.concat(F.transform("_c", lambda c: c["re"]), F.transform("_c", lambda c: c["im"])).alias("_z"))
    kinds = T.StructType([flat.schema[k] for k in keys] + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])

    def run(batches):
        hann, m = _hann(size), size // 2 + 1
        for b, both in _same_length(batches, "_z"):
            rows, n = len(both), both.shape[1] // (2 * m)
            z = (both[:, : n * m] + 1j * both[:, n * m :]).reshape(rows, n, m)
            frames = np.fft.irfft(z, size, axis=2) * hann
            out, norm = np.zeros((rows, (n - 1) * hop + size)), np.zeros((n - 1) * hop + size)
            for i in range(n):  # frames of one array, not rows
                out[:, i * hop : i * hop + size] += frames[:, i]
                norm[i * hop : i * hop + size] += hann**2
            x = (out / np.where(norm > 1e-11, norm, 1))[:, size // 2 : size // 2 + length]
            columns = [b.column(b.schema.names.index(k)) for k in keys]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([*columns, lists.cast(arrow.field(name).type)], schema=arrow)

    return flat.mapInArrow(run, kinds)


class SpectrogramImage:
    """Spectra of several channels as images in [-1, 1]: real parts of channels 0 .. C - 1, then the imaginary parts.

    fit() takes the extremes of each cell (channel, frame, frequency) over all samples in one aggregate; the fit is a table as large
    as one image, and may be stored and read again."""

    def __init__(self, size: int, hop: int, length: int, channels: int, fitted: DataFrame | None = None):
        self.size, self.hop, self.length, self.channels, self.fitted = size, hop, length, channels, fitted

    def _cells(self, packs: DataFrame, keys: list[str]) -> DataFrame:
        """keys, channel (also of the imaginary parts), frame, f, value; packs: keys, channel, x."""
        z = stft(packs, [*keys, "channel"], self.size, self.hop)
        both = F.array(F.struct(F.col("channel").cast("int").alias("channel"), F.col("re").alias("value")), F.struct((F.col("channel") + self.channels).cast("int").alias("channel"), F.col("im").alias("value")))
        return z.select(*keys, "frame", "f", F.explode(both).alias("_b")).select(*keys, "_b.channel", "frame", "f", "_b.value")

    def fit(self, packs: DataFrame, keys: list[str]) -> SpectrogramImage:
        self.fitted = self._cells(packs, keys).groupBy("channel", "frame", "f").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        return self

    def transform(self, packs: DataFrame, keys: list[str], eps: float = 1e-7) -> DataFrame:
        """keys, channel, frame, f, value."""
        cells = self._cells(packs, keys).join(self.fitted, ["channel", "frame", "f"])
        scaled = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + eps)
        return cells.select(*keys, "channel", "frame", "f", ((scaled - 0.5) * 2).alias("value"))

    def inverse(self, images: DataFrame, keys: list[str]) -> DataFrame:
        """keys, channel, x; the small eps of transform() is not undone."""
        back = images.join(self.fitted, ["channel", "frame", "f"]).withColumn("value", (F.col("value") / 2 + 0.5) * (F.col("hi") - F.col("lo")) + F.col("lo"))
        part = lambda im: F.max(F.when((F.col("channel") >= self.channels) == F.lit(im), F.col("value")))
        cells = back.groupBy(*keys, (F.col("channel") % self.channels).alias("channel"), "frame", "f").agg(part(False).alias("re"), part(True).alias("im"))
        return istft(cells, [*keys, "channel"], self.size, self.hop, self.length)
