"""Comparing real with generated series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsloom.operators.models import cross_products


def channel_means(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The mean over channels of each sample and step."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def histogram(df: DataFrame, side: str, bins: int = 200, value: str = "value") -> DataFrame:
    """side, bin, p: equal bins over each side's own range, the last one closed. Nulls and NaN are left out."""
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranges = df.groupBy(side).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    rows = df.join(F.broadcast(ranges), side)  # two sides
    return rows.groupBy(side, place.cast("int").alias("bin")).agg((F.count("*") / F.first("_n")).alias("p"))


def jensen_shannon(hist: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """The square root of the divergence (natural logarithm) of two sides' histograms, by bin number."""
    both = hist.groupBy("bin").agg(F.sum(F.when(F.col(side) == a, F.col("p")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(side) == b, F.col("p")).otherwise(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0)
    return both.agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("jsd"))


def density(df: DataFrame, side: str, points: int, bandwidth: float, lo: float, hi: float, value: str = "value") -> DataFrame:
    """Gaussian kernel density on a grid. Each row meets the short grid in a generator; sums combine before the shuffle."""
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    rows = df.withColumn("i", F.explode(grid)).withColumn("at", lo + F.col("i") * (hi - lo) / (points - 1.0))
    z = (F.col("at") - F.col(value)) / bandwidth
    return rows.groupBy(side, "i", "at").agg((F.avg(F.exp(-0.5 * z * z)) / (bandwidth * float(np.sqrt(2 * np.pi)))).alias("density"))


def moments(df: DataFrame, by: list[str], vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Means (by, i, mu) and sample covariances (by, i, j, cov) of arrays without nulls.

    Each Arrow batch adds up its products of vectors that end in a 1, so sums and counts come with them: dim^2 rows a batch and
    group go to the exchange, not dim^2 a vector."""
    x = F.concat(F.transform(vector, lambda v: v.cast("double")), F.array(F.lit(1.0)))
    n = dim + 1
    sums = cross_products(df.select(*by, x.alias("_x"), F.array(F.lit(1.0)).alias("_y")), by, n, 1)
    at = lambda i, j: F.get("s", i * (n + 1) + j)
    size = at(F.lit(dim), F.lit(dim))
    cells = sums.select(*by, "s", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("i"))
    means = cells.select(*by, "i", (at(F.col("i"), F.lit(dim)) / size).alias("mu"))
    pairs = cells.select(*by, "s", "i", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("j"))
    cov = (at(F.col("i"), F.col("j")) - at(F.col("i"), F.lit(dim)) * at(F.col("j"), F.lit(dim)) / size) / F.nullif(size - 1, F.lit(0.0))
    return means, pairs.select(*by, "i", "j", cov.alias("cov"))


def frechet_diagonal(df: DataFrame, side: str, vector: str) -> DataFrame:
    """Squared distance of means plus squared distance of standard deviations, dimension by dimension."""
    cells = df.select(side, F.posexplode(vector).alias("i", "x"))
    each = cells.groupBy("i", side).agg(F.avg(F.col("x").cast("double")).alias("mu"), F.stddev_samp(F.col("x").cast("double")).alias("sd"))
    pair = each.groupBy("i").agg(*[F.max(F.when(F.col(side) == s, F.col(c))).alias(f"{c}{s}") for c in ("mu", "sd") for s in (0, 1)])
    gap = lambda c: (F.col(f"{c}0") - F.col(f"{c}1")) ** 2
    return pair.agg(F.sum(gap("mu") + gap("sd")).alias("fid"))


def frechet(df: DataFrame, side: str, vector: str, dim: int) -> DataFrame:
    """Fréchet distance of two sides: moments in Spark; the eigenvalues of a dim x dim product in one task."""
    means, covs = moments(df, [side], vector, dim)
    rows = means.select(side, "i", F.lit(-1).alias("j"), F.col("mu").alias("x")).union(covs.select(side, "i", "j", F.col("cov").alias("x")))

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = sorted(pdf[side].unique())
        mu, cov = [], []
        for s in sides:
            one = pdf[pdf[side] == s]
            mu.append(one[one.j < 0].sort_values("i").x.to_numpy())
            cov.append(one[one.j >= 0].sort_values(["i", "j"]).x.to_numpy().reshape(dim, dim))
        roots = np.sqrt(np.linalg.eigvals(cov[0] @ cov[1]).astype(complex)).real.sum()
        return pd.DataFrame({"fid": [float(((mu[0] - mu[1]) ** 2).sum() + np.trace(cov[0]) + np.trace(cov[1]) - 2 * roots)]})

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(distance, "fid double")  # 2 * (dim^2 + dim) rows


def projected(df: DataFrame, side: str, real, vector: str, k: int = 2) -> DataFrame:
    """Principal components fitted on one side, both sides centred by its mean; the largest loading of each is positive."""
    base = df.withColumn("_x", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    fitted = base.where(F.col(side) == real)
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(fitted)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    centre = fitted.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_m"))
    out = model.transform(base).withColumn("_p", vector_to_array("_p")).crossJoin(F.broadcast(centre))
    dot = lambda c: F.aggregate(F.zip_with("_m", F.array(*[F.lit(float(v)) for v in load[:, c]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return out.withColumns({f"pc{c + 1}": (F.col("_p")[c] - dot(c)) * float(sign[c]) for c in range(k)}).drop("_x", "_p", "_m")


def accuracy(df: DataFrame, by: list[str], predicted: str, label: str) -> DataFrame:
    """accuracy and the discriminative score |0.5 - accuracy|."""
    return df.groupBy(*by).agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy")).withColumn("score", F.abs(0.5 - F.col("accuracy")))


def two_level_error(df: DataFrame, by: list[str], series: str, predicted: str, actual: str) -> DataFrame:
    """The mean over series of each series' mean absolute error."""
    each = df.groupBy(*by, series).agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("_e"))
    return each.groupBy(*by).agg(F.avg("_e").alias("mae"))


def suite(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and population deviation over repeats, to four places (half to even); -1 stands for a disabled metric."""
    return scores.groupBy(*by).agg(F.coalesce(F.bround(F.avg(value), 4), F.lit(-1.0)).alias("mean"), F.coalesce(F.bround(F.stddev_pop(value), 4), F.lit(-1.0)).alias("std"))


def running_best(scores: DataFrame, by: list[str], epoch: str, value: str) -> DataFrame:
    """is_best where a score is below all before it."""
    before = F.min(value).over(Window.partitionBy(*by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    return scores.withColumn("is_best", F.coalesce(F.col(value) < before, F.lit(True)).cast("int"))


def size_name(n: Column) -> Column:
    """A whole number as 1.2K, 3.45M or 5.6G of 1024: above one unit, in its multiples to two places (half to even)."""
    short = lambda k, u: F.concat(F.bround(n / float(k), 2).cast("string"), F.lit(u))
    return F.when(n > 2**30, short(2**30, "G")).when(n > 2**20, short(2**20, "M")).when(n > 2**10, short(2**10, "K")).otherwise(n.cast("string"))


def duration_name(seconds: Column) -> Column:
    """Seconds as 06s, 04m:05s, 01h:02m:03s or 2d:01h:02m:03s."""
    s = F.floor(seconds).cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    hours = F.when(s >= 86400, F.format_string("%dd:%02dh:%02dm:%02ds", d, h, m, r)).when(s >= 3600, F.format_string("%02dh:%02dm:%02ds", h, m, r))
    return hours.when(s >= 60, F.format_string("%02dm:%02ds", m, r)).otherwise(F.format_string("%02ds", r))


def parameter_counts(parts: DataFrame, group: str, count: str, trainable: str) -> DataFrame:
    """group, trainable, non_trainable, total of each group of parameters and of all of them (group "overall"), as short names."""
    sums = parts.groupBy(F.col(group).cast("string").alias(group)).agg(F.sum(F.when(F.col(trainable), F.col(count)).otherwise(0)).alias("trainable"), F.sum(F.when(F.col(trainable), 0).otherwise(F.col(count))).alias("non_trainable"))
    every = sums.agg(F.lit("overall").alias(group), F.coalesce(F.sum("trainable"), F.lit(0)).alias("trainable"), F.coalesce(F.sum("non_trainable"), F.lit(0)).alias("non_trainable"))
    both = sums.union(every).withColumn("total", F.col("trainable") + F.col("non_trainable"))
    return both.select(group, *[size_name(F.col(c)).alias(c) for c in ("trainable", "non_trainable", "total")])
