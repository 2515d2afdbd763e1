"""Generated sources, with draws from hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsloom.functions.hashing import order, uniform


def sines(spark: SparkSession, n: int, length: int, channels: int) -> DataFrame:
    """sines_of() the samples 0 to n - 1."""
    return sines_of(spark.range(n), "id", length, channels)


def sines_of(samples: DataFrame, ids: str, length: int, channels: int) -> DataFrame:
    """sample_id, t, channel, value: (sin(f t + phase) + 1) / 2 with f and phase in [0, 0.1) for each sample and channel."""
    rows = samples.select(F.col(ids).alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    rows = rows.withColumns({"_f": uniform(F.col("sample_id"), F.col("channel"), "f") * 0.1, "_p": uniform(F.col("sample_id"), F.col("channel"), "p") * 0.1})
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return rows.withColumn("value", (F.sin(F.col("_f") * F.col("t") + F.col("_p")) + 1) / 2).drop("_f", "_p")


def dropped_out(df: DataFrame, series: list[str], rate: float, length: int, seed: int) -> DataFrame:
    """value is null on int(length * rate) drawn steps of each series."""
    line = Window.partitionBy(*series).orderBy(order(*[F.col(c) for c in series], F.col("t"), seed), "t")
    return df.withColumn("value", F.when(F.row_number().over(line) > int(length * rate), F.col("value")))


def cells_dropped_out(df: DataFrame, cells: list[str], rate: float, seed: int, value: str = "value", digits: int = 3, least: int = 4096) -> DataFrame:
    """value is null on exactly int(rows * rate) drawn cells of the whole table; cells are the columns that name a row.

    The cells of least hash go. Counts of hash ranges find the range in which the last of them lies, then counts of its ranges,
    until `least` rows or fewer are left, which alone are sorted: one hash and cell is the bound that every row is held against."""
    key = order(*[F.col(c) for c in cells], seed)
    hashed = df.select(*cells, key.alias("_h"))
    wanted = int(df.count() * rate)
    if not wanted:
        return df
    prefix, rest = "", wanted
    while len(prefix) < 30:
        inside = hashed.where(F.col("_h").startswith(prefix))
        sizes = inside.groupBy(F.substring("_h", len(prefix) + 1, digits).alias("r")).count().orderBy("r").collect()  # at most 16^digits rows
        if sum(r["count"] for r in sizes) <= least:
            break
        for r in sizes:
            if rest <= r["count"]:
                prefix += r["r"]
                break
            rest -= r["count"]
    bound = hashed.where(F.col("_h").startswith(prefix)).orderBy("_h", *cells).limit(rest).orderBy(F.desc("_h"), *[F.desc(c) for c in cells]).first()
    gone = F.struct(key.alias("_h"), *[F.col(c) for c in cells]) <= F.struct(*[F.lit(v).cast(hashed.schema[c].dataType).alias(c) for c, v in zip(["_h", *cells], [bound["_h"], *[bound[c] for c in cells]], strict=True)])
    return df.withColumn(value, F.when(~gone, F.col(value)))
