"""Noise schedules, preconditioning, samplers' tables, averages and learning rates. All tables are as long as the schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsloom.functions.hashing import normal



def _steps():
    return Window.orderBy("step")  # schedules have at most some thousand rows



def edm_steps(spark: SparkSession, n: int = 36, lo: float = 0.002, hi: float = 80.0, rho: float = 7.0) -> DataFrame:
    """step, sigma: from hi down to lo, then 0."""
    a, b = hi ** (1 / rho), lo ** (1 / rho)
    steps = spark.range(n).select(F.col("id").alias("step"), F.pow(F.lit(a) + F.col("id") / (n - 1.0) * (b - a), F.lit(rho)).alias("sigma"))
    return steps.unionByName(spark.range(1).select(F.lit(n).cast("long").alias("step"), F.lit(0.0).alias("sigma")))


def linear_betas(spark: SparkSession, n: int) -> DataFrame:
    scale = 1000.0 / n
    lo, hi = scale * 0.0001, scale * 0.02
    return spark.range(n).select(F.col("id").alias("step"), (F.lit(lo) + (hi - lo) * F.col("id") / (n - 1.0)).alias("beta"))


def cosine_betas(spark: SparkSession, n: int, s: float = 0.008) -> DataFrame:
    """1 - f(i + 1) / f(i), at most 0.999."""
    f = lambda i: F.pow(F.cos((i / float(n) + s) / (1 + s) * math.pi / 2), F.lit(2.0))
    i = F.col("id")
    return spark.range(n).select(i.alias("step"), F.least(F.greatest(1.0 - f(i + 1) / f(i), F.lit(0.0)), F.lit(0.999)).alias("beta"))


def alpha_bars(betas: DataFrame) -> DataFrame:
    """alpha_bar, the running product of 1 - beta, and alpha_bar_prev."""
    out = betas.withColumn("alpha_bar", F.exp(F.sum(F.log(1.0 - F.col("beta"))).over(_steps())))
    return out.withColumn("alpha_bar_prev", F.lag("alpha_bar", 1, 1.0).over(_steps()))


def posterior(alphas: DataFrame) -> DataFrame:
    """Coefficients of the posterior mean, its variance, the clipped log variance and the loss weight."""
    b, a, p = F.col("beta"), F.col("alpha_bar"), F.col("alpha_bar_prev")
    out = alphas.withColumns(
        {
            "variance": b * (1 - p) / (1 - a),
            "coef_x0": b * F.sqrt(p) / (1 - a),
            "coef_xt": (1 - p) * F.sqrt(1 - b) / (1 - a),
            "loss_weight": F.sqrt(1 - b) * F.sqrt(1 - a) / b / 100.0,
        }
    )
    return out.withColumn("log_variance", F.log(F.greatest("variance", F.lit(1e-20))))


def noised(df: DataFrame, alphas: DataFrame, step: str, seed: int, *keys: Column) -> DataFrame:
    """value * sqrt(alpha_bar) + noise * sqrt(1 - alpha_bar) at each row's step; the schedule is a table of its steps."""
    eps = normal(*keys, seed)
    table = F.broadcast(alphas.select(F.col("step").alias(step), "alpha_bar"))  # as many rows as steps
    return df.join(table, step).withColumn("noise", eps).withColumn("noised", F.sqrt("alpha_bar") * F.col("value") + F.sqrt(1 - F.col("alpha_bar")) * F.col("noise"))


def start_from_noise(df: DataFrame) -> DataFrame:
    """x0 from noised, noise and alpha_bar."""
    a = F.col("alpha_bar")
    return df.withColumn("x0", F.sqrt(1 / a) * F.col("noised") - F.sqrt(1 / a - 1) * F.col("noise"))


def posterior_mean(df: DataFrame, coefficients: DataFrame, step: str) -> DataFrame:
    """mean and variance of the step before, from x0 and noised at each row's step; coefficients is what posterior() gives."""
    table = F.broadcast(coefficients.select(F.col("step").alias(step), "coef_x0", "coef_xt", "variance"))  # as many rows as steps
    return df.join(table, step).withColumn("mean", F.col("coef_x0") * F.col("x0") + F.col("coef_xt") * F.col("noised"))


#: Fixed values of the variance-preserving form: slope and start of its beta, number of its noise levels.
VP_SLOPE, VP_START, VP_LEVELS = 19.9, 0.1, 1000


def vp_time(sigma: Column) -> Column:
    """The time in [0, 1] at which the variance-preserving form has noise sigma."""
    return (F.sqrt(VP_START**2 + 2 * VP_SLOPE * F.log1p(sigma * sigma)) - VP_START) / VP_SLOPE


#: Fixed values of the improved form: bounds of the steps at low and high noise, number of its levels.
IDDPM_LOW, IDDPM_HIGH, IDDPM_LEVELS = 0.001, 0.008, 1000


def iddpm_levels(levels: int = IDDPM_LEVELS) -> list[float]:
    """Noise levels 0, 1, ... of the improved form, falling to 0; each comes from the next one."""
    bar = lambda j: math.sin(0.5 * math.pi * j / levels / (IDDPM_HIGH + 1)) ** 2
    out = [0.0]
    for j in range(levels, 0, -1):
        out.append(math.sqrt((out[-1] ** 2 + 1) / max(bar(j - 1) / bar(j), IDDPM_LOW) - 1))
    return out[::-1]


def nearest_level(x: Column, levels: list[float]) -> Column:
    """The index of the nearest of falling levels (of two as near the first, which is the larger), by binary search in a literal of their number."""
    rising = F.array(*[F.lit(float(v)) for v in reversed(levels)])
    n = len(levels)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(rising, mid) < x
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(done | ~up, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | up, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, halve, lambda s: s["lo"])
    below = F.greatest(at - 1, F.lit(0))
    return F.lit(n - 1) - F.when(F.abs(F.get(rising, below) - x) < F.abs(F.get(rising, at) - x), below).otherwise(at)


def _ratio(a: Column, b: Column) -> Column:
    """a / b for a > 0 and b >= 0: infinite where b is 0, also in ANSI mode."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(a / b)


def _ln(x: Column) -> Column:
    """The logarithm as IEEE has it: of 0 minus infinity, of less NaN."""
    return F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def preconditioning(sigma: Column, data: float = 0.5, kind: str = "edm") -> dict[str, Column]:
    """c_skip, c_out, c_in, c_noise and the loss weight; a level of 0 has an infinite weight."""
    s2, d2 = sigma * sigma, data * data
    if kind == "ve":
        return {"c_skip": F.lit(1.0), "c_out": sigma, "c_in": F.lit(1.0), "c_noise": _ln(0.5 * sigma), "weight": _ratio(F.lit(1.0), s2)}
    if kind == "iddpm":
        return {"c_skip": F.lit(1.0), "c_out": -sigma, "c_in": 1 / F.sqrt(s2 + 1), "c_noise": F.lit(IDDPM_LEVELS - 1) - nearest_level(sigma, iddpm_levels()), "weight": _ratio(F.lit(1.0), s2)}
    if kind == "vp":
        return {"c_skip": F.lit(1.0), "c_out": -sigma, "c_in": 1 / F.sqrt(s2 + 1), "c_noise": (VP_LEVELS - 1) * vp_time(sigma), "weight": _ratio(F.lit(1.0), s2)}
    return {"c_skip": d2 / (s2 + d2), "c_out": sigma * data / F.sqrt(s2 + d2), "c_in": 1 / F.sqrt(s2 + d2), "c_noise": _ln(sigma) / 4, "weight": _ratio(s2 + d2, (sigma * data) * (sigma * data))}


def ema(packs: DataFrame, decay: float, name: str = "x", warm: int = 0) -> DataFrame:
    """The moving average of each array, with decay min(decay, (1 + n) / (10 + n)); the first `warm` values replace it."""
    state = F.struct(F.col(name)[0].alias("m"), F.lit(0).alias("n"))
    d = lambda n: F.least(F.lit(decay), (1.0 + n) / (10.0 + n))
    step = lambda s, x: F.struct(F.when(s["n"] < warm, x).otherwise(s["m"] * d(s["n"] + 1) + x * (1 - d(s["n"] + 1))).alias("m"), (s["n"] + 1).alias("n"))
    return packs.withColumn("ema", F.aggregate(F.slice(name, F.lit(2), F.size(name)), state, step, lambda s: s["m"]))


def cosine_rates(spark: SparkSession, steps: int, warm: int, top: float, low: float = 0.0) -> DataFrame:
    """Linear warm-up, then a half cosine down to low."""
    i = F.col("id")
    curve = low + (top - low) * 0.5 * (1 + F.cos(math.pi * (i - warm) / float(steps - warm)))
    return spark.range(steps).select(i.alias("step"), F.when(i < warm, top * (i + 1) / float(warm)).otherwise(curve).alias("lr"))


def plateau_rates(packs: DataFrame, start: float, factor: float, patience: int, threshold: float = 1e-4, least: float = 0.0, name: str = "x", warm: int = 0, warm_top: float = 0.0, cooldown: int = 0, eps: float = 1e-8) -> DataFrame:
    """The rate after a run of losses: times factor whenever more than `patience` losses in a row bring no improvement.

    The first `warm` losses raise the rate in even steps to warm_top, and are not looked at. After a cut, `cooldown` losses
    count as no bad ones. A cut smaller than eps is left out."""
    rise = max(0.0, warm_top - start) / warm if warm else 0.0
    state = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("cool"), F.lit(start).alias("lr"), F.lit(0).alias("n"))

    def step(s, x):
        warming = s["n"] < warm
        better = x < s["best"] * (1 - threshold)
        bad = F.when(better | (s["cool"] > 0), 0).otherwise(s["bad"] + 1)
        cool = F.greatest(s["cool"] - 1, F.lit(0))
        cut = bad > patience
        lower = F.greatest(s["lr"] * factor, F.lit(least))
        return F.struct(
            F.when(~warming & better, x).otherwise(s["best"]).alias("best"),
            F.when(warming, s["bad"]).when(cut, 0).otherwise(bad).alias("bad"),
            F.when(warming, s["cool"]).when(cut, cooldown).otherwise(cool).alias("cool"),
            F.when(warming, F.greatest(s["lr"] + rise, F.lit(least))).when(cut & (s["lr"] - lower > eps), lower).otherwise(s["lr"]).alias("lr"),
            (s["n"] + 1).alias("n"),
        )

    return packs.withColumn("lr", F.aggregate(name, state, step, lambda s: s["lr"]))


def masked_loss(df: DataFrame, by: list[str], weight: Column, out: Column, x: Column, mask: Column) -> DataFrame:
    """The mean of weight * (out - x)^2 over all cells, those masked out counting as 0."""
    return df.groupBy(*by).agg(F.avg(weight * (out - x) * (out - x) * (1 - mask)).alias("loss"))


def diagonal_kl(mean: Column, log_var: Column, prior_mean: Column, prior_log_var: Column) -> Column:
    """KL divergence of diagonal normals, one dimension."""
    return 0.5 * (prior_log_var - log_var + F.exp(log_var - prior_log_var) + (mean - prior_mean) * (mean - prior_mean) * F.exp(-prior_log_var) - 1)
