"""Windows, padding and reshaping of series."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_count(n: Column, length: int, stride: int = 1, tail: bool = True) -> Column:
    """Number of windows of a series of n points; without tail the last start is left out."""
    return F.greatest(F.lit(0), F.floor((n - length) / stride) + (1 if tail else 0)).cast("long")


def window_stats(df: DataFrame, series: list[str], length: int, stride: int = 1, tail: bool = True, t: str = "t", value: str = "value") -> DataFrame:
    """series, start, mean, sd (population), total of each window, by one running frame: nothing is multiplied or packed."""
    line = Window.partitionBy(*series).orderBy(t)
    frame = line.rowsBetween(0, length - 1)
    n = F.count("*").over(Window.partitionBy(*series))
    out = df.select(*series, F.col(t).alias("start"), n.alias("n"), *[f(value).over(frame).alias(a) for f, a in ((F.avg, "mean"), (F.stddev_pop, "sd"), (F.sum, "total"))])
    last = F.col("n") - length - (0 if tail else 1)
    return out.where((F.col("start") <= last) & (F.col("start") % stride == 0)).drop("n")


def exploded_windows(df: DataFrame, series: list[str], length: int, stride: int = 1, tail: bool = True, t: str = "t") -> DataFrame:
    """series, start, pos and the other columns: each row once for every window it is in. A generator, no join."""
    n = F.count("*").over(Window.partitionBy(*series))
    last = F.floor((F.col("_n") - length - (0 if tail else 1)) / stride)
    lo = F.greatest(F.lit(0), F.ceil((F.col(t) - length + 1) / stride))
    hi = F.least(F.floor(F.col(t) / stride), last)
    out = df.withColumn("_n", n).withColumns({"_lo": lo, "_hi": hi}).where("_hi >= _lo")
    out = out.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("start", F.col("_k") * stride)
    return out.withColumn("pos", F.col(t) - F.col("start")).drop("_n", "_lo", "_hi", "_k")


def covering_windows(df: DataFrame, series: list[str], length: int, t: str = "t") -> DataFrame:
    """series, start, pos and the other columns of windows that follow each other, and one more that ends with the series where
    they miss its end: each row is in one window or two. Series shorter than the length have none."""
    n = F.count("*").over(Window.partitionBy(*series))
    starts = F.array_distinct(F.array(F.floor(F.col(t) / length) * length, F.col("_n") - length))
    inside = F.filter(starts, lambda s: (s >= 0) & (s <= F.col(t)) & (F.col(t) < s + length) & (s + length <= F.col("_n")))
    out = df.withColumn("_n", n).withColumn("start", F.explode(inside))
    return out.withColumn("pos", F.col(t) - F.col("start")).drop("_n")


def packed(df: DataFrame, series: list[str], t: str = "t", value: str = "value", name: str = "x") -> DataFrame:
    """One ordered array for each series."""
    return df.groupBy(*series).agg(F.transform(F.sort_array(F.collect_list(F.struct(t, value))), lambda s: s[value]).alias(name))


def unpacked(df: DataFrame, series: list[str], name: str = "x") -> DataFrame:
    return df.select(*series, F.posexplode(name).alias("t", "value"))


def tumbled(df: DataFrame, series: list[str], length: int, t: str = "t", value: str = "value") -> DataFrame:
    """Statistics of full blocks of `length` points."""
    return df.groupBy(*series, F.floor(F.col(t) / length).alias("block")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("hi")).where(F.col("n") == length).drop("n")


def context_blocks(df: DataFrame, series: list[str], context: int, t: str = "t") -> DataFrame:
    """Rows of the blocks of `context` steps that a table padded to the longest series is cut into, without its final block and those
    with padding: a block is kept if the series fills it, and if it is not the last one of the longest series."""
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy(*series))).withColumn("block", F.floor(F.col(t) / context))
    longest = df.agg(F.max(F.col(t) + 1).alias("_longest"))  # one row
    df = df.crossJoin(F.broadcast(longest))
    return df.where(((F.col("block") + 1) * context <= F.col("_n")) & (F.col("block") < F.ceil(F.col("_longest") / context) - 1)).drop("_n", "_longest")


def history_and_horizon(packs: DataFrame, length: int, label: int, horizon: int, name: str = "x") -> DataFrame:
    """Arrays past and future of each window: past = [s, s + length), future = [s + length - label, s + length + horizon)."""
    starts = F.sequence(F.lit(0), F.size(name) - length - horizon)
    out = packs.where(F.size(name) >= length + horizon).withColumn("start", F.explode(starts))
    return out.withColumns({"past": F.slice(name, F.col("start") + 1, length), "future": F.slice(name, F.col("start") + 1 + length - label, label + horizon)}).drop(name)


def right_padded(x: str, length: int, fill: float = 0.0) -> Column:
    """The array, clipped or padded at its end to a length."""
    c = F.col(x)
    return F.concat(F.slice(c, 1, length), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(c))))


def keep_mask(x: str, length: int) -> Column:
    """1 where right_padded() has own values."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (i < F.size(F.col(x))).cast("int"))


def nan_padded(x: str, left: int, right: int) -> Column:
    """The array with nulls on both sides."""
    none = lambda k: F.array_repeat(F.lit(None).cast("double"), k)
    return F.concat(none(left), F.col(x), none(right))


def sections(packs: DataFrame, count: int, name: str = "x") -> DataFrame:
    """Even sections, the first size % count of them one longer; shorter ones are filled up with nulls to the first one's length."""
    n = F.size(name)
    out = packs.withColumns({"_q": F.floor(n / count).cast("int"), "_r": n % count}).withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    begin = F.col("section") * F.col("_q") + F.least("section", "_r")
    part = F.slice(F.col(name), begin + 1, F.col("_q") + (F.col("section") < F.col("_r")).cast("int"))
    width = F.col("_q") + (F.col("_r") > 0).cast("int")
    return out.withColumn(name, F.concat(part, F.array_repeat(F.lit(None).cast("double"), width - F.size(part)))).drop("_q", "_r")


def cropped(x: str, offset: Column, length: int) -> Column:
    """length values from an offset of each row's own."""
    return F.slice(F.col(x), offset + 1, length)


def crop_pair(length: int, seed: int, least: int = 2) -> tuple[int, int, int, int]:
    """(outer left, left, right, outer right) of two views that overlap in [left, right), drawn from a seed."""
    draw = random.Random(seed)
    width = draw.randint(least, length)
    left = draw.randint(0, length - width)
    return draw.randint(0, left), left, left + width, draw.randint(left + width, length)


def crop_views(x: str, length: int, pair: tuple[int, int, int, int], u: Column) -> tuple[Column, Column]:
    """Both views of an array, moved by an offset that u, a uniform of the row, draws from those that keep them inside."""
    outer_left, left, right, outer_right = pair
    offset = F.floor(u * (length - outer_right + outer_left + 1)).cast("int") - outer_left
    return cropped(x, offset + outer_left, right - outer_left), cropped(x, offset + left, outer_right - left)


def centred(x: str) -> Column:
    """Values between leading and trailing nulls moved to the middle by rotation."""
    c = F.col(x)
    present = F.filter(F.transform(c, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    lead, trail = F.array_min(present), F.size(c) - 1 - F.array_max(present)
    k = F.floor((lead + trail) / 2).cast("int") - lead
    shift = F.pmod(-k, F.size(c))
    return F.when(F.size(present) == 0, c).otherwise(F.concat(F.slice(c, shift + 1, F.size(c)), F.slice(c, F.lit(1), shift)))


def square_padded(df: DataFrame, side: int, keys: list[str]) -> DataFrame:
    """Image cells (r, c, value) filled up to side x side with zeros; mask is 1 on the filled columns."""
    width = df.groupBy(*keys).agg(F.max("c").alias("_w"))
    cells = width.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    out = cells.join(df, [*keys, "r", "c"], "left")
    return out.withColumns({"value": F.coalesce("value", F.lit(0.0)), "mask": (F.col("c") > F.col("_w")).cast("int")}).drop("_w")


def square_unpadded(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """The cells (r, c) of an image as it was before square_padded()."""
    return image.where((F.col("r") < rows) & (F.col("c") < columns))


def widest(frames: list[DataFrame], prefix: str = "ch_", least: int = 1) -> int:
    """The number of channels of the widest frame, at least `least`."""
    return max([least, *(sum(c.startswith(prefix) for c in f.columns) for f in frames)])


def channel_padded(frames: list[DataFrame], channels: int | None = None, prefix: str = "ch_") -> DataFrame:
    """The union of wide frames, missing channels as 0; as many as the widest frame has, or as said."""
    channels = widest(frames, prefix) if channels is None else channels
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    names = [f"{prefix}{i}" for i in range(channels)]
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) if n in out.columns else F.lit(0.0) for n in names})


def multiscale_pooled(df: DataFrame, series: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """series, t, p, pooled: running maxima of 2^(p + 1) + 1 points, 2^p on both sides, for each p with 2^p + 1 below the series' length.

    Dyadic: a window is covered by two of the level before, 2^(p - 1) steps to each side (at the ends: by the first and the last
    one). So each level is two lags over the same sorted rows, however wide it is; steps are 0, 1, ... without gaps."""
    line, all_ = Window.partitionBy(*series).orderBy(t), Window.partitionBy(*series).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longest = df.agg(F.max(t)).first()[0]
    levels = max(0, ((longest or 0) - 1).bit_length())
    out = df.select(*series, t, F.greatest(F.lag(value, 1).over(line), value, F.lead(value, 1).over(line)).alias("_p0"), F.count("*").over(all_).alias("_n"))
    for p in range(1, levels):
        last, half = f"_p{p - 1}", 1 << (p - 1)
        before = F.coalesce(F.lag(last, half).over(line), F.first(last).over(all_))
        after = F.coalesce(F.lead(last, half).over(line), F.last(last).over(all_))
        out = out.withColumn(f"_p{p}", F.greatest(before, after))
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_p{p}").alias("pooled")) for p in range(levels)])
    out = out.withColumn("_e", F.explode(F.filter(each, lambda e: F.pow(F.lit(2), e["p"]) + 1 < F.col("_n")))) if levels else out.withColumn("_e", F.explode(F.array().cast("array<struct<p:int,pooled:double>>")))
    return out.select(*series, t, "_e.p", "_e.pooled")


def whole_pooled(df: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """The maximum of each whole series."""
    return df.groupBy(*series).agg(F.max(value).alias("pooled"))


def pooled(df: DataFrame, series: list[str], k: int, t: str = "t", value: str = "value") -> DataFrame:
    """Running maximum of k points, k // 2 before; an even k leaves the last place out."""
    before = k // 2
    w = Window.partitionBy(*series).orderBy(t).rowsBetween(-before, k - 1 - before)
    return df.withColumn("pooled", F.max(value).over(w))
