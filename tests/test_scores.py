"""The discriminative score with its repeats side by side, and its number of generated series."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tsloom.operators import models


def test_repeats_side_by_side_give_the_same_score(spark):
    rng = np.random.default_rng(4)
    rows = [(side, i, t, float(v)) for side in (0, 1) for i in range(60) for t, v in enumerate(rng.uniform(0.2 * side, 1, 8))]
    df = spark.createDataFrame(rows, "side int, series_id long, t long, value double")
    real, generated = (df.where(F.col("side") == k).drop("side") for k in (1, 0))
    one, many = (models.discriminative(real, generated, repeats=3, iterations=10, parallel=k).first() for k in (1, 3))
    assert one == many and 0 < one.disc_mean <= 0.5


def test_as_many_generated_series_as_windows(spark, tmp_path):
    day, lengths = datetime.datetime(2024, 1, 1), [23, 24, 25, 48, 1]
    rows = [(u * 100 + i, day + datetime.timedelta(minutes=i), u, float(i)) for u, n in enumerate(lengths) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    real, generated = models.real_and_generated(spark, str(tmp_path))
    assert real.select("series_id").distinct().count() == generated.select("series_id").distinct().count() == 5
