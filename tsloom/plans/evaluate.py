"""The whole run: prepare windows of named datasets, fit a generator, sample as many, and score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.operators import metrics, models, prepare, sample, windows

DISABLED = -1.0


@dataclass
class Config:
    """Typed options of a run."""

    length: int = 24
    subset_p: float | None = None
    subset_n: int | None = None
    seed: int = 0
    repeats: int = 10
    iterations: int = 50
    metrics: list[str] = field(default_factory=lambda: ["disc", "pred", "jsd"])


def prepared(df: DataFrame, config: Config, train: bool = True) -> DataFrame:
    """series_id (series and first step), t, value: min-max scaled windows that cover each series of at least `length` steps; for training
    the seeded subset, for evaluation all."""
    s = windows.covering_windows(df.select("series_id", "t", "value"), ["series_id"], config.length)
    s = s.select(F.concat_ws(":", "series_id", "start").alias("series_id"), F.col("pos").alias("t"), "value")
    s = prepare.scaled(s, prepare.stats(s, []), [], "minmax", 1e-7)
    if not train or config.subset_p is None and config.subset_n is None:
        return s
    names = sample.globally_ranked(s.select("series_id").distinct(), config.seed, F.col("series_id"))
    n = F.col("_n")
    n = prepare.share(n, config.subset_p) if config.subset_p is not None else F.lit(config.subset_n)
    return s.join(sample.subset(names, n).select("series_id").distinct(), "series_id", "left_semi")


def evaluate(spark: SparkSession, datasets: dict[str, DataFrame], handler: models.Handler, config: Config, epoch: int = 0) -> DataFrame:
    """dataset, epoch, metric, value for each dataset, and the mean over datasets as dataset "mean"; disabled metrics are -1."""
    out = None
    for name, df in datasets.items():
        real = prepared(df, config, train=False)
        model = handler.fit(prepared(df, config))
        fake = model.sample(spark, real.select("series_id").distinct().count(), config.length, config.seed).select("series_id", "t", "value")
        parts = []
        if "disc" in config.metrics:
            parts.append(models.discriminative(real, fake, config.repeats, config.iterations))
        if "pred" in config.metrics:
            parts.append(models.predictive(real, fake, config.repeats))
        if "jsd" in config.metrics:
            both = real.withColumn("side", F.lit("real")).unionByName(fake.withColumn("side", F.lit("fake")), allowMissingColumns=True)
            parts.append(metrics.jensen_shannon(metrics.histogram(both, "side"), "side", "real", "fake"))
        if "fid" in config.metrics:
            pack = lambda x, side: models.summary_embedding(windows.packed(x, ["series_id"])).select(F.lit(side).alias("side"), "embedding")
            parts.append(metrics.frechet(pack(real, 0).union(pack(fake, 1)), "side", "embedding", 7))
        names = ["disc_mean", "disc_std", "pred_mean", "pred_std", "jsd", "fid"]
        for p in parts:
            one = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in p.columns])).alias("s")).select(F.lit(name).alias("dataset"), "s.metric", "s.value")
            out = one if out is None else out.union(one)
            names = [n for n in names if n not in p.columns]
        if names:
            off = spark.createDataFrame([(name, n, DISABLED) for n in names], "dataset string, metric string, value double")
            out = off if out is None else out.union(off)
    mean = out.groupBy("metric").agg(F.bround(F.avg("value"), 4).alias("value")).select(F.lit("mean").alias("dataset"), "metric", "value")
    return out.union(mean).select("dataset", F.lit(epoch).alias("epoch"), "metric", "value")
