"""Generators, post-hoc scores, the linear Koopman operator, and t-SNE.

The scores' models are fitted by Spark ML's distributed aggregation over all series.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsloom.functions.hashing import digits, normal, order, uniform
from tsloom.operators.sample import globally_ranked
from tsloom.operators.windows import covering_windows
from tsloom.session import table


class Handler(Protocol):
    """What a generative model has to offer."""

    def fit(self, real: DataFrame) -> Handler:
        """Trains on series_id, t, value."""

    def sample(self, spark: SparkSession, n: int, length: int, seed: int, class_id: int | None = None) -> DataFrame:
        """n series of series_id, t, value."""


class AutoRegression:
    """value(t + 1) = a + b * value(t) + noise, fitted in one aggregate over all series."""

    def fit(self, real: DataFrame) -> AutoRegression:
        line = Window.partitionBy("series_id").orderBy("t")
        pairs = real.withColumn("y", F.lead("value").over(line)).where("y IS NOT NULL")
        r = pairs.agg(F.regr_slope("y", "value").alias("b"), F.regr_intercept("y", "value").alias("a"), F.stddev_pop("y").alias("sd"), F.corr("y", "value").alias("c"), F.avg("value").alias("m")).first()
        self.a, self.b, self.mean = r.a or 0.0, r.b or 0.0, r.m or 0.0
        self.noise = (r.sd or 0.0) * max(0.0, 1 - (r.c or 0.0) ** 2) ** 0.5
        return self

    def sample(self, spark: SparkSession, n: int, length: int, seed: int, class_id: int | None = None) -> DataFrame:
        steps = F.sequence(F.lit(0), F.lit(length - 1))
        shocks = F.transform(steps, lambda t: normal(F.col("series_id"), t, seed) * self.noise)
        fold = F.aggregate(shocks, F.array(F.lit(float(self.mean))), lambda xs, e: F.concat(xs, F.array(self.a + self.b * F.element_at(xs, -1) + e)))
        return spark.range(n).withColumnRenamed("id", "series_id").select("series_id", F.posexplode(F.slice(fold, 2, length)).alias("t", "v")).select("series_id", F.col("t").cast("long").alias("t"), digits(F.col("v")).alias("value"))


def _as_windows(real: DataFrame, length: int) -> DataFrame:
    """series_id (series and first step), t, value of windows that cover each series; shorter series have none."""
    cut = covering_windows(real.select("series_id", "t", "value"), ["series_id"], length)
    return cut.select(F.concat_ws(":", "series_id", "start").alias("series_id"), F.col("pos").alias("t"), "value")


class Jitter:
    """Real windows with normal noise of a share of the overall deviation."""

    def __init__(self, share: float = 0.1):
        self.share = share

    def fit(self, real: DataFrame) -> Jitter:
        self.real, self.sd = real, real.agg(F.stddev_pop("value")).first()[0] or 0.0
        return self

    def sample(self, spark: SparkSession, n: int, length: int, seed: int, class_id: int | None = None) -> DataFrame:
        cut = _as_windows(self.real, length)
        names = globally_ranked(cut.select("series_id").distinct(), seed, F.col("series_id")).where(F.col("rank") < n)
        rows = cut.join(names, "series_id", "left_semi")
        return rows.select("series_id", "t", (F.col("value") + self.share * self.sd * normal(F.col("series_id"), F.col("t"), seed)).alias("value"))


class BlockBootstrap:
    """Blocks of consecutive steps, each from a drawn window of the real series, at the place it has there."""

    def __init__(self, block: int = 6):
        self.block = block

    def fit(self, real: DataFrame) -> BlockBootstrap:
        self.real = real
        return self

    def sample(self, spark: SparkSession, n: int, length: int, seed: int, class_id: int | None = None) -> DataFrame:
        cut = _as_windows(self.real, length)
        names = globally_ranked(cut.select("series_id").distinct(), 0, F.col("series_id"), "slot")
        want = spark.range(n).select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit((length - 1) // self.block))).alias("block"))
        want = want.withColumn("slot", F.floor(uniform(F.col("sample_id"), F.col("block"), seed) * names.count()))
        rows = cut.withColumn("block", F.floor(F.col("t") / self.block)).join(names, "series_id")
        return want.join(rows, ["slot", "block"]).select(F.col("sample_id").alias("series_id"), "t", "value")


def real_and_generated(spark: SparkSession, d: str, length: int = 24) -> tuple[DataFrame, DataFrame]:
    """All windows of the event series (covering_windows), scaled to [0, 1], and as many series from the autoregression."""
    e = table(spark, d, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    steps = e.select("user_id", t.cast("long").alias("t"), (F.col("value") / 500.0).alias("value"))
    cut = covering_windows(steps, ["user_id"], length)
    real = cut.select(F.concat_ws(":", "user_id", "start").alias("series_id"), F.col("pos").alias("t"), "value")
    # as many windows as cover each user, without making them
    lengths = e.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= length)
    count = lengths.agg(F.sum(F.ceil(F.col("n") / length))).first()[0] or 0
    return real, AutoRegression().fit(real).sample(spark, count, length, seed=3)


def _packs(df: DataFrame, side: int) -> DataFrame:
    """side, key, x, one ordered array for each series."""
    each = df.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda s: s["value"]).alias("x"))
    return each.select(F.lit(side).alias("side"), F.col("series_id").cast("string").alias("key"), "x")


def discriminative(real: DataFrame, generated: DataFrame, repeats: int = 10, iterations: int = 50, parallel: int = 4) -> DataFrame:
    """mean and std over repeats of |0.5 - accuracy| of a classifier that tells real from generated series.

    A logistic regression on values, squares and products of neighbours, fitted by distributed aggregation on 80 % of the
    series, drawn by a hash for each repeat, and judged on the rest; `parallel` repeats run at a time. Nulls count as 0, as do the missing steps of shorter series."""
    packs = _packs(real, 1).union(_packs(generated, 0)).persist()
    longest = packs.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat(F.transform("x", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))), F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("x")))
    steps = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x")), lambda a, b: a * b)
    trains = F.array(*[uniform(F.col("side"), F.col("key"), rep, "part") < 0.8 for rep in range(repeats)])
    both = packs.withColumn("x", filled).select(F.col("side").cast("double").alias("label"), array_to_vector(F.concat("x", F.transform("x", lambda v: v * v), steps)).alias("features"), trains.alias("trains")).persist()
    both.count()
    packs.unpersist()

    def score(rep: int) -> tuple[float]:
        train = F.col("trains")[rep]
        model = LogisticRegression(maxIter=iterations, regParam=1e-4).fit(both.where(train))
        right = model.transform(both.where(~train)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first().a
        return (abs(0.5 - (0.5 if right is None else right)),)

    # a fit is many short jobs that one after the other leave cores idle
    with ThreadPool(min(parallel, repeats)) as pool:
        scores = pool.map(inheritable_thread_target(real.sparkSession)(score), range(repeats))
    both.unpersist()
    df = real.sparkSession.createDataFrame(scores, "score double")
    return df.agg(F.bround(F.avg("score"), 4).alias("disc_mean"), F.bround(F.stddev_pop("score"), 4).alias("disc_std"))


def predictive(real: DataFrame, generated: DataFrame, repeats: int = 10, lags: int = 4, channels: list[str] | None = None) -> DataFrame:
    """mean and std over repeats of the next-step error on real series of a predictor trained on generated ones.

    A linear regression predicts the last channel's next value from the other channels' (of one channel: its own) last `lags`
    values, 0 before the start. Each repeat trains on 80 % of the generated series, drawn by a hash. Nulls count as 0."""
    channels = channels or ["value"]
    line = Window.partitionBy("series_id").orderBy("t")
    inputs = channels[:-1] or channels

    def pairs(df: DataFrame) -> DataFrame:
        filled = df.select("series_id", "t", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in channels])
        past = [F.lag(c, k, 0.0).over(line) for c in inputs for k in range(lags)]
        return filled.select("series_id", array_to_vector(F.array(*past)).alias("features"), F.lead(channels[-1]).over(line).alias("label")).where("label IS NOT NULL")

    fake, true = pairs(generated).persist(), pairs(real).persist()
    scores = []
    for rep in range(repeats):
        model = LinearRegression(regParam=1e-6, solver="normal").fit(fake.where(uniform(F.col("series_id"), rep, "part") < 0.8))
        each = model.transform(true).groupBy("series_id").agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("e"))
        scores.append((each.agg(F.avg("e").alias("e")).first().e,))
    fake.unpersist()
    true.unpersist()
    df = real.sparkSession.createDataFrame(scores, "score double")
    return df.agg(F.bround(F.avg("score"), 4).alias("pred_mean"), F.bround(F.stddev_pop("score"), 4).alias("pred_std"))


def koopman(df: DataFrame, by: list[str], t: str, x: str, dim: int) -> DataFrame:
    """by, i, j, a: the matrix that best maps each step's vector to the next one's within each group (least squares)."""
    nxt = F.lead(x).over(Window.partitionBy(*by).orderBy(t))
    return koopman_of_pairs(df.withColumn("_y", nxt).where("_y IS NOT NULL").select(*by, F.col(x).alias("_x"), "_y"), by, dim)


def koopman_of_pairs(pairs: DataFrame, by: list[str], dim: int) -> DataFrame:
    """koopman() of pairs (by, _x, _y)."""
    m = operators_of(pairs, by, dim)
    return m.select(*by, F.posexplode("a").alias("_k", "a")).select(*by, F.floor(F.col("_k") / dim).cast("int").alias("i"), (F.col("_k") % dim).alias("j"), "a")


def cross_products(pairs: DataFrame, by: list[str], dim: int, other: int | None = None) -> DataFrame:
    """by, s: the sums of X'X and X'Y of arrays _x (dim long) and _y (as long, or `other`) side by side, a matrix row by row.

    Each Arrow batch adds up its groups' products; a group's sums then meet place by place."""
    kinds = "".join(f"{k} {pairs.schema[k].dataType.simpleString()}, " for k in by)

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = (np.stack([np.asarray(a, float) for a in pdf[c]]) for c in ("_x", "_y"))
            keys = pdf[by].drop_duplicates().reset_index(drop=True) if by else pd.DataFrame(index=[0])
            code = pdf[by].merge(keys.reset_index(), on=by, how="left")["index"].to_numpy() if by else np.zeros(len(pdf), int)
            by_group = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[by_group], prepend=-1))
            both = np.concatenate([x, y], axis=1)
            out = keys.iloc[code[by_group][cuts]].reset_index(drop=True)
            out["s"] = [(x[g].T @ both[g]).ravel() for g in np.split(by_group, cuts[1:])]
            yield out

    sums = pairs.mapInPandas(partial, f"{kinds}s array<double>")
    cells = sums.select(*by, F.posexplode("s").alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    return cells.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("s"))


def operators_of(pairs: DataFrame, by: list[str], dim: int) -> DataFrame:
    """by, a: each group's least-squares matrix, row by row; the small systems of a batch are solved at once."""
    sums = cross_products(pairs, by, dim)
    kinds = "".join(f"{k} {sums.schema[k].dataType.simpleString()}, " for k in by)

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            both = np.stack([np.asarray(v, float) for v in pdf["s"]]).reshape(-1, dim, 2 * dim)
            a = np.linalg.pinv(both[:, :, :dim], hermitian=True, rcond=1e-12) @ both[:, :, dim:]
            out = pdf[by].copy()
            out["a"] = list(a.reshape(len(pdf), -1))
            yield out

    return sums.mapInPandas(solve, f"{kinds}a array<double>")


def eigenvalue_penalties(operators: DataFrame, by: list[str], dim: int) -> DataFrame:
    """by, top2, top3, every: the mean squared distance to 1 of the two, the three and all largest magnitudes of each group's eigenvalues;
    and moduli, the magnitudes in falling order. A batch of matrices (arrays a, row by row) is one call of the eigensolver."""
    kinds = "".join(f"{k} {operators.schema[k].dataType.simpleString()}, " for k in by)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack([np.asarray(v, float) for v in pdf["a"]]).reshape(-1, dim, dim)
            size = -np.sort(-np.abs(np.linalg.eigvals(m)), axis=1)
            out = pdf[by].copy()
            for name, k in (("top2", 2), ("top3", 3), ("every", dim)):
                out[name] = ((size[:, :k] - 1) ** 2).mean(axis=1)
            out["moduli"] = list(size)
            yield out

    return operators.mapInPandas(run, f"{kinds}top2 double, top3 double, every double, moduli array<double>")


def roll_out_error(paths: DataFrame, operators: DataFrame, by: list[str], t: str, x: str, dim: int, steps: int) -> DataFrame:
    """by, error: over k = 1 .. steps, the sum of the mean squared error of each vector times the operator's k-th power against the
    vector k steps later, divided by the Frobenius norm of these predictions.

    Later vectors are leads over one sort; a row carries its predictions no further than its own expression."""
    line = Window.partitionBy(*by).orderBy(t)
    rows = paths.select(*by, t, F.col(x).alias("_z"), *[F.lead(x, k).over(line).alias(f"_y{k}") for k in range(1, steps + 1)]).join(operators.select(*by, "a"), by)
    kinds = "".join(f"{k} {paths.schema[k].dataType.simpleString()}, " for k in by)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.stack([np.asarray(v, float) for v in pdf["_z"]])
            a = np.stack([np.asarray(v, float) for v in pdf["a"]]).reshape(-1, dim, dim)
            for k in range(1, steps + 1):
                z = np.einsum("bi,bij->bj", z, a)
                there = pdf[f"_y{k}"].notna().to_numpy()
                if not there.any():
                    continue
                y = np.stack([np.asarray(v, float) for v in pdf[f"_y{k}"][there]])
                out = pdf[by][there].copy()
                out["k"], out["sq"], out["norm"] = k, ((z[there] - y) ** 2).sum(1), (z[there] ** 2).sum(1)
                yield out

    parts = rows.mapInPandas(run, f"{kinds}k int, sq double, norm double")
    each = parts.groupBy(*by, "k").agg((F.sum("sq") / (F.count("*") * dim) / F.sqrt(F.sum("norm"))).alias("e"))
    return each.groupBy(*by).agg(F.sum("e").alias("error"))


def tsne(df: DataFrame, ids: str, vector: str, sample: int = 1000, perplexity: float = 40.0, iterations: int = 300, seed: int = 0) -> DataFrame:
    """ids, x, y of a seeded sample of at most `sample` rows: the method itself is quadratic and for plots."""
    rows = df.select(ids, vector).orderBy(order(F.col(ids), seed)).limit(sample)

    def embed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ids)
        x = np.stack([np.asarray(v, float) for v in pdf[vector]])
        n = len(x)
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        p = np.zeros((n, n))
        goal = np.log(min(perplexity, max(2.0, (n - 1) / 3)))
        for i in range(n):
            lo, hi, beta = 0.0, np.inf, 1.0
            row = np.delete(d[i], i)
            for _ in range(50):
                w = np.exp(-(row - row.min()) * beta)
                q = w / w.sum()
                entropy = -(q * np.log(np.maximum(q, 1e-300))).sum()
                if abs(entropy - goal) < 1e-5:
                    break
                lo, hi = (beta, hi) if entropy > goal else (lo, beta)
                beta = beta * 2 if hi == np.inf else (lo + hi) / 2
            p[i, np.arange(n) != i] = q
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        y, v = np.random.default_rng(seed).normal(0, 1e-4, (n, 2)), np.zeros((n, 2))
        for k in range(iterations):
            w = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
            np.fill_diagonal(w, 0)
            g = (p * (12 if k < 100 else 1) - np.maximum(w / w.sum(), 1e-12)) * w
            grad = 4 * (np.diag(g.sum(1)) - g) @ y
            v = (0.5 if k < 100 else 0.8) * v - max(n / 48, 50) * grad
            y = y + v
            y -= y.mean(0)
        return pd.DataFrame({ids: pdf[ids].to_numpy(), "x": y[:, 0], "y": y[:, 1]})

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(embed, f"{ids} {df.schema[ids].dataType.simpleString()}, x double, y double")


def summary_embedding(packs: DataFrame, x: str = "x") -> DataFrame:
    """The default representation of a series: mean, deviation, ends, extremes and mean step."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    sq = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n
    return packs.withColumn("embedding", F.array(mean, F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))), F.col(x)[0], F.element_at(x, -1), F.array_min(x), F.array_max(x), (F.element_at(x, -1) - F.col(x)[0]) / n))


def heun(spark: SparkSession, denoise, sigmas: list[float], n: int, length: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """n series from noise by Heun's method over falling noise levels: denoise(x, sigma) -> x for an array (rows, length).

    Rows are independent, so partitions sample on their own; known (series_id, x with nulls for missing points) is kept at each
    step, which imputes or forecasts the rest."""
    base = spark.range(n).withColumnRenamed("id", "series_id")
    base = base.join(known.select("series_id", "x"), "series_id", "left") if known is not None else base.withColumn("x", F.lit(None).cast("array<double>"))

    def run(batches):
        for pdf in batches:
            x = np.stack([np.random.default_rng([seed, int(i)]).normal(0, sigmas[0], length) for i in pdf.series_id]) if len(pdf) else np.zeros((0, length))
            told = np.stack([np.full(length, np.nan) if v is None else np.array([np.nan if u is None else u for u in v], float) for v in pdf.x]) if len(pdf) else x
            fixed = ~np.isnan(told)
            for a, b in zip(sigmas, sigmas[1:]):
                x = np.where(fixed, np.nan_to_num(told), x)
                d = (x - denoise(x, a)) / a
                y = x + (b - a) * d
                if b > 0:
                    y = x + (b - a) * 0.5 * (d + (y - denoise(y, b)) / b)
                x = y
            x = np.where(fixed, np.nan_to_num(told), x)
            yield pd.DataFrame({"series_id": pdf.series_id, "x": list(x)})

    return base.mapInPandas(run, "series_id long, x array<double>")


def ddpm(spark: SparkSession, predict, alpha_bars: list[float], n: int, length: int, seed: int, eta: float = 1.0, steps: int | None = None) -> DataFrame:
    """n series by ancestral sampling (eta 1) or its deterministic, shortened form (eta 0): predict(x, step) -> x0."""
    chosen = np.unique(np.linspace(0, len(alpha_bars) - 1, steps or len(alpha_bars)).astype(int))[::-1]

    def run(batches):
        for pdf in batches:
            rngs = [np.random.default_rng([seed, int(i)]) for i in pdf.series_id]
            x = np.stack([r.normal(size=length) for r in rngs]) if len(pdf) else np.zeros((0, length))
            for k, step in enumerate(chosen):
                a = alpha_bars[step]
                prev = alpha_bars[chosen[k + 1]] if k + 1 < len(chosen) else 1.0
                x0 = predict(x, int(step))
                eps = (x - np.sqrt(a) * x0) / np.sqrt(1 - a)
                sd = eta * np.sqrt((1 - prev) / (1 - a) * (1 - a / prev))
                x = np.sqrt(prev) * x0 + np.sqrt(max(1 - prev - sd**2, 0)) * eps
                if sd > 0:
                    x = x + sd * np.stack([r.normal(size=length) for r in rngs])
            yield pd.DataFrame({"series_id": pdf.series_id, "x": list(x)})

    return spark.range(n).withColumnRenamed("id", "series_id").mapInPandas(run, "series_id long, x array<double>")
