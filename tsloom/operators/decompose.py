"""Trend, season and bases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(df: DataFrame, series: list[str], k: int, stride: int = 1, t: str = "t", value: str = "value", name: str = "trend") -> DataFrame:
    """The mean of k points with both ends repeated: k - 1 - (k - 1) // 2 before, (k - 1) // 2 after.

    A clipped frame gives the sum of the points there are; the end points count once more for each missing one."""
    after = (k - 1) // 2
    before = k - 1 - after
    line, all_ = Window.partitionBy(*series).orderBy(t), Window.partitionBy(*series)
    n = F.count("*").over(all_)
    first, last = F.min_by(value, t).over(all_), F.max_by(value, t).over(all_)
    short_front, short_back = F.greatest(F.lit(0), before - F.col(t)), F.greatest(F.lit(0), F.col(t) + after - (n - 1))
    total = F.sum(value).over(line.rowsBetween(-before, after)) + first * short_front + last * short_back
    out = df.withColumn(name, total / k)
    return out if stride == 1 else out.where(F.col(t) % stride == 0)


def decomposed(df: DataFrame, series: list[str], k: int, t: str = "t", value: str = "value") -> DataFrame:
    """trend and the residual season."""
    return moving_average(df, series, k, 1, t, value).withColumn("season", F.col(value) - F.col("trend"))


def mixed_trend(df: DataFrame, series: list[str], kernels: list[int], slopes: list[float], intercepts: list[float], t: str = "t", value: str = "value") -> DataFrame:
    """trend, the moving averages of several kernels weighted by the softmax of slope * value + intercept of each, and the residual season.

    All averages are frames over one sort."""
    for k in kernels:
        df = moving_average(df, series, k, 1, t, value, f"_m{k}")
    logits = [F.col(value) * a + b for a, b in zip(slopes, intercepts, strict=True)]
    most = F.greatest(*logits) if len(logits) > 1 else logits[0]
    weights = [F.exp(x - most) for x in logits]
    total = sum(weights[1:], weights[0])
    mixed = sum((F.col(f"_m{k}") * w for k, w in zip(kernels[1:], weights[1:], strict=True)), F.col(f"_m{kernels[0]}") * weights[0]) / total
    return df.withColumn("trend", mixed).withColumn("season", F.col(value) - F.col("trend")).drop(*[f"_m{k}" for k in kernels])


def block_kernel(length: int) -> int:
    """The moving block's kernel for a length."""
    return int(max(min(length / 4, 24), 4))


def trend_projection(df: DataFrame, series: list[str], length: int, powers: int = 3, t: str = "t", value: str = "value") -> DataFrame:
    """series, p, value: inner products with ((t + 1) / (length + 1)) to the p-th, p from 1. Each row meets the short basis in a generator."""
    rows = df.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(powers))))
    return rows.groupBy(*series, "p").agg(F.sum(F.col(value) * F.pow((F.col(t) + 1) / (length + 1.0), F.col("p"))).alias("value"))


def season_count(length: int, factor: int = 1) -> int:
    """How many channels the season's basis has for a length."""
    return factor * min(32, length // 2)


def season_wave(channel: Column, t: Column, length: int, channels: int) -> Column:
    """Cosines of 1, 2, ... turns for the first half of the channels (rounded down), then sines of 1, 2, ... turns."""
    half = channels // 2
    turns = F.when(channel < half, channel + 1).otherwise(channel - half + 1)
    angle = 2.0 * math.pi * turns * t / length
    return F.when(channel < half, F.cos(angle)).otherwise(F.sin(angle))


def season_projection(df: DataFrame, series: list[str], length: int, channels: int | None = None, t: str = "t", value: str = "value") -> DataFrame:
    """series, channel, value: inner products with the season's basis."""
    channels = channels or season_count(length)
    rows = df.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    return rows.groupBy(*series, "channel").agg(F.sum(F.col(value) * season_wave(F.col("channel"), F.col(t), length, channels)).alias("value"))


def spectrum(df: DataFrame, series: list[str], length: int, t: str = "t", value: str = "value") -> DataFrame:
    """re and im of frequencies 1 .. (length - 1) // 2: each row meets a short list of frequencies, sums combine before the shuffle."""
    rows = df.where(F.col(t) < length).withColumn("f", F.explode(F.sequence(F.lit(1), F.lit((length - 1) // 2))))
    angle = 2.0 * math.pi * F.col("f") * F.col(t) / length
    return rows.groupBy(*series, "f").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(-F.col(value) * F.sin(angle)).alias("im"))


def top_count(length: int, factor: float = 1.0) -> int:
    """How many frequencies stand for a length: the logarithm of the number of those that spectrum() gives."""
    return int(factor * math.log((length - 1) // 2))


def strongest(spec: DataFrame, series: list[str], k: int) -> DataFrame:
    """The k frequencies of greatest amplitude (rounded; ties: the lower one) of each series."""
    amp = F.round(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 6)
    line = Window.partitionBy(*series).orderBy(F.desc("amp"), "f")
    return spec.withColumn("amp", amp).withColumn("rk", F.row_number().over(line)).where(F.col("rk") <= k)


def extrapolated(top: DataFrame, series: list[str], length: int, steps: int) -> DataFrame:
    """The sum of the chosen frequencies and their conjugates over steps points, also beyond the length; amplitudes are not divided by the length."""
    phase = F.atan2("im", "re")
    rows = top.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    wave = 2.0 * F.col("amp") * F.cos(2.0 * math.pi * F.col("f") * F.col("t") / length + phase)
    return rows.groupBy(*series, "t").agg(F.sum(wave).alias("value"))


def fourier_loss(df: DataFrame, series: list[str], length: int, a: str, b: str, t: str = "t") -> DataFrame:
    """loss: the mean absolute difference of the real parts, plus that of the imaginary parts, of two columns' full spectra (divided by the length)."""
    rows = df.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("_gap", F.col(a) - F.col(b))
    angle = 2.0 * math.pi * F.col("f") * F.col(t) / length
    each = rows.groupBy(*series, "f").agg(F.sum(F.col("_gap") * F.cos(angle)).alias("re"), F.sum(-F.col("_gap") * F.sin(angle)).alias("im"))
    return each.groupBy(*series).agg(((F.avg(F.abs("re")) + F.avg(F.abs("im"))) / length).alias("loss"))


def image_spectral_loss(cells: DataFrame, keys: list[str], side: int, a: str, b: str) -> DataFrame:
    """keys, loss: the mean over side x side image cells of the squared difference of two columns plus that of their two-dimensional
    spectra (divided by side^2), whose real and imaginary parts count apart.

    The transform is separable: rows first, columns then. Each pass is a grouped sum over `side` terms, combined before its
    exchange; cells that are not there count as 0."""
    gap = (F.col(a) - F.col(b)).cast("double")
    frequencies = F.sequence(F.lit(0), F.lit(side - 1))
    angle = lambda f, x: 2.0 * math.pi * F.col(f) * F.col(x) / side
    rows = cells.select(*keys, "r", "c", gap.alias("_g")).withColumn("_fc", F.explode(frequencies))
    rows = rows.groupBy(*keys, "r", "_fc").agg(F.sum(F.col("_g") * F.cos(angle("_fc", "c"))).alias("_re"), F.sum(-F.col("_g") * F.sin(angle("_fc", "c"))).alias("_im"), F.sum(F.when(F.col("_fc") == 0, F.col("_g") * F.col("_g")).otherwise(0.0)).alias("_t"))
    both = rows.withColumn("_fr", F.explode(frequencies))
    cos, sin = F.cos(angle("_fr", "r")), F.sin(angle("_fr", "r"))
    spec = both.groupBy(*keys, "_fr", "_fc").agg(F.sum(F.col("_re") * cos + F.col("_im") * sin).alias("_re"), F.sum(F.col("_im") * cos - F.col("_re") * sin).alias("_im"), F.sum(F.when(F.col("_fr") == 0, F.col("_t")).otherwise(0.0)).alias("_t"))
    n = float(side * side)
    return spec.groupBy(*keys).agg(((F.sum(F.col("_re") ** 2 + F.col("_im") ** 2) / (n * n) + F.sum("_t")) / n).alias("loss"))
