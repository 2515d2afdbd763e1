"""Helpers that the operators share: durable intermediate tables, unique column names, ASCII folding."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a fresh temporary
    folder, and any other a ValueError: its executors would not see a folder of the driver."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tsloom-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


#: Spark then deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of tables of texts that are read once or twice: neither distinct values are looked for nor the last tenth of the space.
_QUICK = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}


def _write(df: DataFrame, name: str, partitions: int | None, quick: bool = False) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.options(compression="zstd", **(_QUICK if quick else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation.

    The table stays; an operator that needs it for a while only takes Tables."""
    return _write(df, name, partitions)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Tables:
    """Stored tables that an operator deletes when all that rests on them is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str, partitions: int | None = None, quick: bool = False) -> DataFrame:
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            out, path = _write(df, name, partitions, quick)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        self.paths[id(out)] = (out, path)  # holds out, so that its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these; without arguments, all that are left."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for k in [id(t) for t in tables] or [*self.paths]:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(k)[1])
            path.getFileSystem(conf).delete(path, True)

    def keep(self, table: DataFrame) -> DataFrame:
        """table, which drop() then leaves alone."""
        self.paths.pop(id(table))
        return table


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than it must to tell."""
    return df.limit(max_rows + 1).count() <= max_rows
