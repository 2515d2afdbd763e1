"""Splits, scalers, imputation and length rules for long series frames (series columns, t, value)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsloom.functions.hashing import order
from tsloom.operators.sample import globally_sorted


def indexed(df: DataFrame, series: list[str], by: list[str], name: str = "t") -> DataFrame:
    """Positions 0, 1, ... within each series."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*series).orderBy(*by)).cast("long") - 1)


def with_length(df: DataFrame, series: list[str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*series)))


def share(n: Column, part: float) -> Column:
    """floor(n * part) for part as it is written: 63 of 90 at 0.7, where doubles give 62.99...9."""
    return F.floor(n.cast("long") * F.lit(Decimal(repr(part)))).cast("long")


def ratio_split(df: DataFrame, look_back: int, train: float = 0.7, test: float = 0.2) -> dict[str, DataFrame]:
    """Train, validation and test by position (columns t, n); the later two begin look_back rows early."""
    a, c = share(F.col("n"), train), share(F.col("n"), test)
    t, n = F.col("t"), F.col("n")
    return {"train": df.where(t < a), "val": df.where((t >= a - look_back) & (t < n - c)), "test": df.where(t >= n - c - look_back)}


def calendar_split(df: DataFrame, look_back: int, per_hour: int = 1) -> dict[str, DataFrame]:
    """12, 4 and 4 months of 30 days by position; validation and test begin look_back rows early."""
    month = 30 * 24 * per_hour
    a, b, c = 12 * month, 16 * month, 20 * month
    t = F.col("t")
    return {"train": df.where(t < a), "val": df.where((t >= a - look_back) & (t < b)), "test": df.where((t >= b - look_back) & (t < c))}


def same_start_split(df: DataFrame, look_back: int, train: float = 0.8) -> dict[str, DataFrame]:
    """Train, and the rest as both validation and test."""
    a, t = share(F.col("n"), train), F.col("t")
    rest = df.where(t >= a - look_back)
    return {"train": df.where(t < a), "val": rest, "test": rest}


def tail_split(df: DataFrame, keep: float = 0.8) -> DataFrame:
    """The last part of each series."""
    return df.where(F.col("t") >= share(F.col("n"), keep))


def labelled_splits(df: DataFrame, look_back: int, train: float, test: float | None) -> DataFrame:
    """df once for each split it is in (column split: train, val, test), in one pass; test None: val and test are both the rest.

    The same rows as ratio_split() and same_start_split() give, without a scan for each part."""
    t, n = F.col("t"), F.col("n")
    a = share(n, train)
    if test is None:
        inside = {"train": t < a, "val": t >= a - look_back, "test": t >= a - look_back}
    else:
        c = n - share(n, test)
        inside = {"train": t < a, "val": (t >= a - look_back) & (t < c), "test": t >= c - look_back}
    names = F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in inside.items()]))
    return df.withColumn("split", F.explode(names))


def random_split(df: DataFrame, ids: str, seed: int, part: float = 0.8) -> DataFrame:
    """df with split, train or test, by rank in a seeded order of ids (one row each).

    Ranks come from a hash order, so counts of hash ranges place the cut without sorting all rows in one task."""
    h = order(seed, F.col(ids))
    ranges = df.select(F.substring(h, 1, 3).alias("r")).groupBy("r").agg(F.count("*").alias("c"))
    line = Window.orderBy("r")  # at most 4096 rows
    ranges = ranges.select("r", (F.sum("c").over(line) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    ranked = df.withColumn("_h", h).join(F.broadcast(ranges.withColumnRenamed("r", "_r")), F.substring("_h", 1, 3) == F.col("_r"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", ids)) - 1
    return ranked.withColumn("split", F.when(rank < share(F.col("n"), part), "train").otherwise("test")).drop("_h", "_r", "before", "n")


def stats(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean, sd_pop, sd_samp, lo, hi of each group, in one aggregate."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd_pop"), F.stddev_samp(v).alias("sd_samp"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def scaled(df: DataFrame, fitted: DataFrame, by: list[str], how: str, eps: float = 0.0, value: str = "value") -> DataFrame:
    """df with value scaled by statistics fitted elsewhere: how is standard, sample or minmax.

    A standard deviation of zero counts as one. The statistics join on the series, so a few rows are broadcast by size and
    many are shuffled."""
    df = df.join(fitted, by) if by else df.crossJoin(F.broadcast(fitted))
    v = F.col(value)
    new = {
        "standard": (v - F.col("mean")) / F.when(F.col("sd_pop") == 0, 1.0).otherwise(F.col("sd_pop")),
        "sample": (v - F.col("mean")) / (F.col("sd_samp") + eps),
        "minmax": (v - F.col("lo")) / (F.col("hi") - F.col("lo") + eps),
    }[how]
    return df.withColumn(value, new).drop("mean", "sd_pop", "sd_samp", "lo", "hi")


def unscaled(df: DataFrame, fitted: DataFrame, by: list[str], how: str, eps: float = 0.0, value: str = "value") -> DataFrame:
    """The inverse of scaled()."""
    df = df.join(fitted, by) if by else df.crossJoin(F.broadcast(fitted))
    v = F.col(value)
    old = {
        "standard": v * F.when(F.col("sd_pop") == 0, 1.0).otherwise(F.col("sd_pop")) + F.col("mean"),
        "sample": v * (F.col("sd_samp") + eps) + F.col("mean"),
        "minmax": v * (F.col("hi") - F.col("lo") + eps) + F.col("lo"),
    }[how]
    return df.withColumn(value, old).drop("mean", "sd_pop", "sd_samp", "lo", "hi")


def scaled_within(df: DataFrame, series: list[str], how: str, eps: float = 0.0, value: str = "value") -> DataFrame:
    """Each series scaled by its own statistics."""
    w, v = Window.partitionBy(*series), F.col(value)
    new = {
        "sample": (v - F.avg(v).over(w)) / F.stddev_samp(v).over(w),
        "minmax": (v - F.min(v).over(w)) / (F.max(v).over(w) - F.min(v).over(w) + eps),
    }[how]
    return df.withColumn(value, new)


def instance_normed(df: DataFrame, series: list[str], channel: str, eps: float = 1e-5, t: str = "t", value: str = "value") -> DataFrame:
    """value less its mean over time, by the deviation over the channels of what is left at each step: sqrt(population variance + eps)."""
    left = df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*series, channel)))
    return left.withColumn(value, F.col(value) / F.sqrt(F.var_pop(value).over(Window.partitionBy(*series, t)) + eps))


def to_signed(x: Column) -> Column:
    """[0, 1] to [-1, 1]."""
    return x * 2.0 - 1.0


def to_unit(x: Column) -> Column:
    """[-1, 1] to [0, 1]."""
    return (x + 1.0) * 0.5


def interpolated(df: DataFrame, series: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """Missing values on the line between their neighbours by position; at the ends the nearest value; all missing: unchanged."""
    w = Window.partitionBy(*series).orderBy(t)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(t))
    df = df.withColumns({"_v0": F.last(value, True).over(back), "_t0": F.last(at, True).over(back), "_v1": F.first(value, True).over(ahead), "_t1": F.first(at, True).over(ahead)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(t) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    return df.withColumn(value, F.coalesce(F.col(value), F.when(F.col("_t1") > F.col("_t0"), line), "_v0", "_v1")).drop("_v0", "_t0", "_v1", "_t1")


def zero_filled(x: Column) -> Column:
    """NaN and null to 0, infinities to the largest finite values."""
    most = 1.7976931348623157e308
    plain = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(plain, F.lit(most)), F.lit(-most))


def missing_edges(df: DataFrame, series: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """series, leading and trailing: how many values are missing before the first and after the last that is there (all: both)."""
    there = F.when(F.col(value).isNotNull(), F.col(t))
    each = df.groupBy(*series).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.min(there).alias("_f"), F.max(there).alias("_l"), F.count("*").alias("_n"))
    return each.select(*series, F.coalesce(F.col("_f") - F.col("_a"), F.col("_n")).cast("long").alias("leading"), F.coalesce(F.col("_b") - F.col("_l"), F.col("_n")).cast("long").alias("trailing"))


def decimated(packed: DataFrame, longest: int = 256, arrays: str = "x") -> DataFrame:
    """If lengths differ anywhere, every second point of each series longer than `longest`."""
    ragged = packed.agg((F.min(F.size(arrays)) != F.max(F.size(arrays))).alias("ragged"))
    out = packed.crossJoin(F.broadcast(ragged))
    return out.withColumn(arrays, F.when(F.col("ragged") & (F.size(arrays) > longest), F.filter(arrays, lambda _, i: i % 2 == 0)).otherwise(F.col(arrays))).drop("ragged")


def length_census(df: DataFrame, series: list[str], channel: str) -> DataFrame:
    """For each series: shortest and longest channel, and whether its channels differ."""
    each = df.groupBy(*series, channel).agg(F.count("*").alias("len"))
    return each.groupBy(*series).agg(F.min("len").alias("min_len"), F.max("len").alias("max_len"), (F.min("len") != F.max("len")).cast("int").alias("ragged"))


def prefix_limit(df: DataFrame, ids: str, limit: float) -> DataFrame:
    """The first ids in order: that many if limit > 1, else that share of them. Ranks come from ranges, not from one sorted task."""
    ranked = globally_sorted(df.select(ids).distinct(), [ids], "_rank", size="_n")
    last = F.lit(int(limit)) if limit > 1 else share(F.col("_n"), limit)
    return df.join(ranked.where(F.col("_rank") < last).select(ids), ids, "left_semi")


def without_missing_series(df: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """Series that have some value."""
    some = df.where(F.col(value).isNotNull()).select(*series).distinct()
    return df.join(some, series, "left_semi")
