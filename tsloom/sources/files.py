"""File readers: CSV in its several shapes, classification text files, item series in JSON lines, NumPy arrays; and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsloom.sources import arrays


def _numbered(df: DataFrame, reverse: bool = False) -> DataFrame:
    """t, the row's place over all files in order of path: counts of partitions give offsets, so nothing is sorted whole."""
    part = df.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    counts = part.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first")).toPandas().sort_values("_p")  # a row for each partition
    starts = (counts["_c"].cumsum() - counts["_c"]).tolist()
    total = int(counts["_c"].sum())
    if not total:
        return df.withColumn("t", F.lit(None).cast("long"))
    offset = F.create_map(*[F.lit(int(x)) for p, o, f in zip(counts["_p"], starts, counts["_first"], strict=True) for x in (p, o - f)])
    t = F.col("_i") + offset[F.col("_p")]
    return part.withColumn("t", (total - 1 - t if reverse else t).cast("long")).drop("_p", "_i")


def dated_csv(spark: SparkSession, path: str, target: str = "OT", features: str = "M", date: str = "date") -> DataFrame:
    """t, ts, then channels with the target last (M and MS: all, S: the target alone)."""
    raw = spark.read.csv(path, header=True)
    names = [c for c in raw.columns if c not in (date, target)] + [target]
    names = [target] if features == "S" else names
    return _numbered(raw.select(F.to_timestamp_ntz(F.col(date)).alias("ts"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names]))


def numeric_csv(spark: SparkSession, path: str, columns: tuple[int, int] | None = None, header: bool = True, reverse: bool = False) -> DataFrame:
    """t and the numeric columns (a slice of them, by position), the rows counted from the end if reverse."""
    raw = spark.read.csv(path, header=header)
    names = raw.columns[slice(*columns)] if columns else raw.columns
    return _numbered(raw.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in names]), reverse)


def anomaly_csv(spark: SparkSession, path: str, drop_first: bool = False, label_last: bool = False) -> DataFrame:
    """t and channels with missing numbers as 0; the first column or a last label column left out."""
    df = numeric_csv(spark, path, (1 if drop_first else 0, -1 if label_last else None))
    return df.select("t", *[F.coalesce(F.nanvl(F.col(f"`{c}`"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in df.columns if c != "t"])


def classification_text(spark: SparkSession, folder: str, flag: str | None = None) -> DataFrame:
    """file, sample_id, label, dims (array of arrays; "?" and NaN null) of .ts files; flag: only files with it in the name, in any case."""
    lines = spark.read.text(folder, pathGlobFilter="*.ts").select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line"))
    if flag:
        lines = lines.where(F.col("file").rlike(f"(?i){flag}"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("@") & ~F.col("line").startswith("#"))
    parts = F.split("line", ":")
    value = lambda v: F.when(~F.isnan(v.try_cast("double")), v.try_cast("double"))
    dims = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: F.transform(F.split(d, ","), lambda v: value(F.trim(v))))
    return _numbered(lines).select("file", F.col("t").alias("sample_id"), F.trim(F.element_at(parts, -1)).alias("label"), dims.alias("dims"))


def nested_to_long(df: DataFrame) -> DataFrame:
    """sample_id, channel, t, value of nested dims."""
    each = df.select("sample_id", F.posexplode("dims").alias("channel", "x"))
    return each.select("sample_id", "channel", F.posexplode("x").alias("t", "value"))


def item_series(spark: SparkSession, path: str) -> DataFrame:
    """item_id, start, target of JSON lines."""
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.StringType()), T.StructField("target", T.ArrayType(T.DoubleType()))])
    df = _numbered(spark.read.schema(schema).json(path))
    return df.select(F.coalesce("item_id", F.col("t").cast("string")).alias("item_id"), F.to_timestamp_ntz("start").alias("start"), "target")


def stacked_items(items: DataFrame, names: list[str]) -> DataFrame:
    """One multivariate series of item series: t and a column for each item."""
    rows = items.select("item_id", F.posexplode("target").alias("t", "value"))
    return rows.groupBy("t").pivot("item_id", names).agg(F.first("value"))


def numpy_arrays(spark: SparkSession, path: str, rows_per_task: int = arrays.ROWS) -> DataFrame:
    """file, t, x (array of all channels of a step) of .npy files of one rank, read in row ranges."""
    df = arrays.read_arrays(spark, path, rows_per_task)
    x = F.col("x")
    kind = df.schema["x"].dataType
    if not isinstance(kind, T.ArrayType):
        x = F.array("x")
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        x, kind = F.flatten(x), kind.elementType
    return df.select("file", F.col("row").alias("t"), x.alias("x"))


def save_frames(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame as Parquet under its key."""
    for key, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{key}")


def load_frames(spark: SparkSession, folder: str, keys: list[str]) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(f"{folder}/{k}") for k in keys}


def append_scores(scores: DataFrame, path: str) -> None:
    """The metric sink: rows of (dataset, epoch, metric, value)."""
    scores.select("dataset", "epoch", "metric", "value").write.mode("append").parquet(path)


def fan_out(sinks: list[Callable[[DataFrame], None]]) -> Callable[[DataFrame], None]:
    """One sink that feeds several; the frame is kept meanwhile."""

    def write(df: DataFrame) -> None:
        df.persist()
        try:
            for s in sinks:
                s(df)
        finally:
            df.unpersist()

    return write
