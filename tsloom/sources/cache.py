"""A Parquet cache of what is costly to compute, under a fingerprint of its inputs and parameters."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, inputs: list[str], params: dict[str, Any]) -> str:
    """A hash of the names, sizes and times of all input files, and of the parameters."""
    files = []
    for path in inputs:
        system, p = _hadoop(spark, path)
        found = system.listFiles(p, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                files.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    told = json.dumps([sorted(files), params], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def cached(spark: SparkSession, folder: str, inputs: list[str], params: dict[str, Any], build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, from the cache if it was built from the same inputs and parameters before.

    A result is written apart and put in its place by one rename, so readers see all of it or nothing. Of two writers the first
    one's rename counts; the other one's copy is deleted, and both read the same table."""
    name = fingerprint(spark, inputs, params)
    target = f"{folder}/{name}"
    system, place = _hadoop(spark, target)
    if not system.exists(place):
        apart = f"_{uuid.uuid4().hex}"
        build().write.parquet(f"{folder}/{apart}")
        source = _hadoop(spark, f"{folder}/{apart}")[1]
        if system.exists(place) or not system.rename(source, place):
            system.delete(source, True)
        # a folder renamed onto one that came in between ends up inside it, where no reader looks at a name with an underscore
        system.delete(_hadoop(spark, f"{target}/{apart}")[1], True)
    return spark.read.parquet(target)
