"""Seeded orders, subsets, batches, catalogues and unions. Orders come from hashes, never from rand()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsloom.functions.hashing import order


def ranked(df: DataFrame, seed: int, ids: Column, within: list[str], name: str = "rank") -> DataFrame:
    """Rank 0, 1, ... in a seeded order within each group."""
    line = Window.partitionBy(*within).orderBy(order(ids, seed), ids)
    return df.withColumn(name, F.row_number().over(line).cast("long") - 1)


def _placed(df: DataFrame, h: Column, ties: list[Column], name: str) -> DataFrame:
    """Rank over all rows by a hexadecimal hash, then ties: counts of hash ranges give each range's offset, so that no task sorts all rows."""
    df = df.withColumn("_h", h).withColumn("_r", F.substring("_h", 1, 3))
    sizes = df.groupBy("_r").agg(F.count("*").alias("_c"))
    offsets = sizes.select("_r", (F.sum("_c").over(Window.orderBy("_r")) - F.col("_c")).alias("_o"))  # at most 4096 rows
    inner = F.row_number().over(Window.partitionBy("_r").orderBy("_h", *ties))
    out = df.join(F.broadcast(offsets), "_r")
    return out.withColumn(name, (F.col("_o") + inner - 1).cast("long")).drop("_h", "_r", "_o")


#: Ranges that a global order is cut into, and rows for each that are looked at to find their bounds.
RANGES, LOOKED_AT = 64, 20


def _range_bounds(df: DataFrame, by: list[str], ranges: int) -> list:
    """At most ranges - 1 rows that cut the order of `by` into about equal parts: quantiles of the rows of least hash."""
    some = df.select(*by).orderBy(F.xxhash64(*by), *by).limit(ranges * LOOKED_AT)
    rows = some.orderBy(*by).collect()  # at most ranges * LOOKED_AT
    return [rows[c] for c in sorted({len(rows) * k // ranges for k in range(1, ranges)} - {0})]


def globally_sorted(df: DataFrame, by: list[str], name: str = "rank", ranges: int = RANGES, size: str | None = None) -> DataFrame:
    """Place 0, 1, ... of every row in the order of `by` over the whole table (ascending, nulls first; rows equal in all of `by` in any order).

    The order is cut into ranges at bounds taken from rows of least hash; counts of the ranges give their offsets, and each range is
    numbered by itself. A value that many rows share is cut as well where `by` goes on behind it. size: adds the number of rows."""
    bounds = _range_bounds(df, by, ranges)
    kinds = [df.schema[c].dataType for c in by]
    whole = F.struct(*by)
    out = df.withColumn("_r", F.lit(0))
    if bounds:
        literal = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for c, v, k in zip(by, r, kinds, strict=True)]) for r in bounds])

        def halve(s: Column, _: Column) -> Column:  # the number of bounds at or below the row, by binary search; nulls come first in a struct's order
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            open_, up = s["lo"] < s["hi"], F.get(literal, mid) <= whole
            return F.struct(F.when(open_ & up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(s["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        out = df.withColumn("_r", F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"]))
    sizes = out.groupBy("_r").agg(F.count("*").alias("_c"))
    all_ranges = Window.orderBy("_r")  # at most `ranges` rows
    offsets = sizes.select("_r", (F.sum("_c").over(all_ranges) - F.col("_c")).alias("_o"), F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("_all"))
    inner = F.row_number().over(Window.partitionBy("_r").orderBy(*[F.asc_nulls_first(c) for c in by]))
    out = out.join(F.broadcast(offsets), "_r").withColumn(name, (F.col("_o") + inner - 1).cast("long"))
    return (out.withColumn(size, F.col("_all")) if size else out).drop("_r", "_o", "_all")


def globally_ranked(df: DataFrame, seed: int, ids: Column, name: str = "rank") -> DataFrame:
    """Rank over all rows in a seeded order."""
    return _placed(df, order(ids, seed), [ids], name)


def shared_prefix(sides: DataFrame, side: str, ids: str, seed: int, most: int = 1000) -> DataFrame:
    """Of each side the rows at the same min(most, rows of the smaller side) drawn places of its order by ids, numbered by draw.

    Places are drawn first: the numbers below the smaller side's size whose hashes are least, ranked by hash ranges. Each side's
    rows get their place from a global order by (side, ids), whose ranges cut a side as well; no task ranks a whole side."""
    counts = sides.groupBy(side).agg(F.count("*").alias("_n"))  # a row for each side
    least = counts.agg(F.min("_n")).first()[0] or 0
    first = counts.select(side, (F.sum("_n").over(Window.orderBy(side)) - F.col("_n")).alias("_first"))
    places = sides.sparkSession.range(least).select(F.col("id").alias("place"))
    drawn = globally_ranked(places, seed, F.col("place"), "draw").where(F.col("draw") < min(most, least))
    ordered = globally_sorted(sides, [side, ids], "_at").join(F.broadcast(first), side).withColumn("place", F.col("_at") - F.col("_first")).drop("_at", "_first")
    return ordered.join(drawn, "place")


def repeated(df: DataFrame, epochs: int, seed: int, ids: Column) -> DataFrame:
    """Every row once in each epoch, with its rank in the epoch's own order: a bounded form of an endless iterator."""
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    line = Window.partitionBy("epoch", "_r").orderBy("_h", ids)
    out = out.withColumn("_h", order(ids, F.col("epoch"), seed)).withColumn("_r", F.substring("_h", 1, 3))
    sizes = out.groupBy("epoch", "_r").agg(F.count("*").alias("_c"))
    offsets = sizes.select("epoch", "_r", (F.sum("_c").over(Window.partitionBy("epoch").orderBy("_r")) - F.col("_c")).alias("_o"))  # at most 4096 rows an epoch
    return out.join(F.broadcast(offsets), ["epoch", "_r"]).withColumn("rank", (F.col("_o") + F.row_number().over(line) - 1).cast("long")).drop("_h", "_r", "_o")


def subset(ranks: DataFrame, n: Column, rank: str = "rank") -> DataFrame:
    """The first n in the order; n beyond the size repeats rows, with copy counting the repeats."""
    size = ranks.agg(F.count("*").alias("_n"))
    out = ranks.crossJoin(F.broadcast(size)).withColumn("_k", n)
    copies = F.ceil((F.col("_k") - F.col(rank)) / F.col("_n")).cast("int")
    out = out.where(F.col(rank) < F.col("_k")).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return out.withColumn("slot", F.col("copy") * F.col("_n") + F.col(rank)).drop("_n", "_k")


def batched(df: DataFrame, size: int, within: list[str], rank: str = "rank", drop_last: bool = False) -> DataFrame:
    out = df.withColumn("batch", F.floor(F.col(rank) / size))
    if drop_last:
        full = F.count("*").over(Window.partitionBy(*within, "batch")) == size
        out = out.withColumn("_full", full).where("_full").drop("_full")
    return out


def interleaved(batches: DataFrame, dataset: str, batch: str, seed: int) -> DataFrame:
    """One random merge of the datasets' batch sequences: slot numbers over all batches, each dataset's batches in their order.

    The k-th smallest key of a dataset goes to its k-th batch; slots follow the keys. A row for each batch only."""
    keyed = batches.withColumn("_key", order(F.col(dataset), F.col(batch), seed))
    kth = keyed.select(dataset, (F.row_number().over(Window.partitionBy(dataset).orderBy("_key")).cast("long") - 1).alias(batch), "_key")
    return _placed(kth, F.col("_key"), [F.col(dataset), F.col(batch)], "slot").drop("_key")


def sharded(df: DataFrame, ranks: int, rank: str = "rank") -> DataFrame:
    """Rows dealt to `ranks` workers in turn; the first rows again fill the last round."""
    size = df.agg(F.count("*").alias("_n"))
    out = df.crossJoin(F.broadcast(size))
    short = F.pmod(-F.col("_n"), F.lit(ranks))
    again = out.where(F.col(rank) < short).withColumn("slot", F.col("_n") + F.col(rank))
    out = out.withColumn("slot", F.col(rank)).unionByName(again).drop("_n")
    return out.withColumn("worker", F.pmod("slot", F.lit(ranks)))


def catalogued(frames: dict[str, DataFrame], catalogue: list[str]) -> DataFrame:
    """The union of named frames with class_id, the place of the name in the catalogue."""
    out = None
    for name, f in frames.items():
        one = f.withColumns({"dataset": F.lit(name), "class_id": F.lit(catalogue.index(name))})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def coded(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Codes 0, 1, ... of a category's values in order (distinct values and their inverse); null has none."""
    codes = globally_sorted(df.where(F.col(column).isNotNull()).select(column).distinct(), [column], name)
    return df.join(codes.withColumn(name, F.col(name).cast("int")), column, "left")


def one_hot(code: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == code).cast("int"))
