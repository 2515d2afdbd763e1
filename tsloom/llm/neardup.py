"""Near-duplicate documents by bottom-k sketches.

A document's set is its distinct runs of five words (one hash function, 63 bits of a 64-bit mix). Its sketch is the K
smallest values. Texts with the same set fall together first. Inverted lists of the retained values then give
overlaps: in the order of rising frequency of values, two sketches that share a part KEEP of their values share one of
their first (1 - KEEP) * |sketch| + 1 (the prefix principle), so only these are listed, and values of common passages hardly
ever are. For each pair that meets in a list, the union of both sketches estimates the similarity; pairs of at least
the least estimate are confirmed by the exact similarity of their full sets. Where the sketch is the whole set, of the document and of any
that can be near it, KEEP is the threshold itself; else it lies SLACK below, 5.2 standard deviations of an estimate from 192 values
at the threshold 0.85. Components of the confirmed links are the groups.

Nulls and odd input: null, empty and wordless texts have an empty set, belong to no group and are kept; a text of one to
four words is one run. A null id never is a component's id (unless all of the group's are null) and is not kept when its
group has another id. Rows that repeat id and text are kept or dropped together; where one
id has several texts, each is judged by itself. An empty table gives an empty result. Other
input columns are kept; result columns replace input columns of the same name. Two different sets share a 63-bit node
key with a probability of 5e-8 among a million texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm import tokens
from tsloom.llm.clusters import link_lists
from tsloom.llm.common import Tables, fresh

K = 192
#: How far the estimate of a pair may fall below the threshold.
SLACK = 0.134
WORDS = 5
#: The query's threshold in percent, and the default of the pipeline's stage.
PERCENT, STAGE_PERCENT = 85, 80


def _sets(batch: pa.RecordBatch, words: int):
    for a, b, raw, at in tokens.blocks(batch.column(1)):
        yield a, b, [s >> np.uint64(1) for s in tokens.shingles(*tokens.words(raw, at), words)]


def _unique(s: np.ndarray) -> np.ndarray:
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """id, key (a hash of the text), n (size of the set), node (63 bits of the set's digest), sketch (the k smallest values)."""

    def run(batches):
        for b in batches:
            for i, j, sets in _sets(b, words):
                sets = [_unique(s).astype(np.int64) for s in sets]
                node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big") >> 1 for s in sets]
                low = [s[:k] for s in sets]
                ends = np.cumsum([0, *map(len, low)], dtype=np.int32)
                values = pa.array(np.concatenate(low) if low else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "key", "n", "node", "sketch"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, key long, n long, node long, sketch array<long>")


def full_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """node, values (the sorted set) of texts (node, text)."""

    def run(batches):
        for b in batches:
            for i, j, sets in _sets(b, words):
                sets = [_unique(s).astype(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "values"])

    return texts.mapInArrow(run, "node long, values array<long>")


def estimate(a, b, n_a, n_b, k: int = K):
    """Share of common values among the k smallest of both sketches' union; exact where both sketches are whole sets."""
    both = F.array_sort(F.array_union(a, b))
    low = F.when((n_a <= k) & (n_b <= k), both).otherwise(F.slice(both, 1, k))
    return F.size(F.array_intersect(low, F.array_intersect(a, b))) / F.size(low)


def judged(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, key (a hash of the text), n_shingles, component_id and kept of each row of docs."""
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("n_shingles", "component_id", "kept")])
    k = K
    tables = Tables(docs.sparkSession)
    # sketches are made again for reps: that takes less time than storing those of all copies does
    sig = tables.store(sketches(base, id_col, text_col, words, k).select("id", "key", "n", "node"), "nodes")
    real = sig.where("n > 0")
    reps = sketches(base, id_col, text_col, words, k).where("n > 0").groupBy("node").agg(F.first("sketch").alias("sketch"))
    reps = tables.store(reps, "sketches")
    # dealt out once by value: the aggregate and the join below need the same columns and conditions, so both read one exchange
    listed = reps.select("node", F.explode("sketch").alias("value")).where("node IS NOT NULL AND value IS NOT NULL").repartition("value")
    shared = listed.groupBy("value").agg(F.count("*").alias("df"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("value", "df")
    ranked = listed.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("by"))  # at most k values
    ranked = ranked.join(real.groupBy("node").agg(F.first("n").alias("n")), "node")
    held = F.least(F.col("n"), F.lit(k))
    whole = F.col("n") * 100 <= percent * k  # then all that can be near it have at most k values
    least = F.when(whole, F.ceil(held * percent / 100)).otherwise(F.greatest(F.lit(1), F.floor(held * (percent / 100 - SLACK))))
    prefix = held - least + 1 - (held - F.size("by"))  # values of one document alone come first, and list nothing
    members = ranked.where(prefix > 0).select(F.explode(F.slice("by", F.lit(1), prefix.cast("int"))).alias("v"), "node", "n", F.when(whole, F.size("by")).otherwise(F.col("n")).cast("long").alias("most")).select(F.col("v.value").alias("list"), "node", F.col("n").alias("size"), "most")
    source = _keyed(base, id_col, text_col)

    members = tables.store(members, "listed")
    tables.drop(reps)
    first = sig.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("id", "key")).alias("row")).select("node", F.col("row.id").alias("row_id"), F.col("row.key").alias("row_key"))
    # ids may be null, or stand for several texts
    sets = full_sets(source.join(first, F.col("id").eqNullSafe(F.col("row_id")) & (F.col("key") == F.col("row_key"))).select("node", "text"), words).groupBy("node").agg(F.first("values").alias("values"))
    sets = tables.store(sets, "listed-sets")
    low = tables.store(sets.select("node", F.size("values").cast("long").alias("n"), F.slice("values", 1, k).alias("sketch")), "listed-sketches")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda s: low.select(F.col("node").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("n").alias(f"n_{s}"))
        slack = F.when((F.col("n_a") <= k) & (F.col("n_b") <= k), 1e-9).otherwise(SLACK)
        likely = pairs.join(side("a"), "a").join(side("b"), "b").where(estimate(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), k) >= percent / 100 - slack)
        likely = tables.store(likely.select("a", "b", "n_a", "n_b"), "likely")
        both = likely.join(sets.select(F.col("node").alias("a"), F.col("values").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("values").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")

    def possible(x, y):
        most = F.least(f"{x}.most", f"{y}.most")
        return 100 * most >= percent * (F.col(f"{x}.size") + F.col(f"{y}.size") - most)

    def sets_of(nodes: DataFrame) -> DataFrame:
        return low.join(nodes, "node", "left_semi").select("node", F.col("sketch").alias("values"))

    def most_apart(x, y):
        # whole sets are apart as the threshold says; of sketches a link shares at least the part that the prefixes rest on
        held = lambda s: F.least(f"{s}.size", F.lit(k))
        common = F.floor(F.greatest(held(x), held(y)) * (percent / 100 - SLACK))
        both = (F.col(f"{x}.size") <= k) & (F.col(f"{y}.size") <= k)
        exact = (F.col(f"{x}.size") + F.col(f"{y}.size")) * (100 - percent) / (100 + percent)
        return F.when(both, exact).otherwise(held(x) + held(y) - 2 * common)

    roots = link_lists(members, verify, possible, sets_of, most_apart, tables)
    nodes = real.groupBy("node").agg(F.min("id").alias("id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    nodes = nodes.join(named, "root").select("node", "component_id")
    found = sig.select("id", "key", "n", "node").join(nodes, "node", "left").select("id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    found = tables.keep(tables.store(found.withColumn("kept", kept), "near-duplicates"))
    tables.drop()
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, n_shingles, component_id and kept of each row of docs."""
    return judged(docs, percent, id_col, text_col, words).drop("key")


def drop_near_duplicates(docs: DataFrame, percent: int = STAGE_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each group."""
    g_id, g_key = fresh(docs, "gone_id", "gone_key")
    gone = judged(docs, percent, id_col, text_col).where("NOT kept").select(F.col("id").alias(g_id), F.col("key").alias(g_key)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[g_id]) & (F.xxhash64(docs[text_col].cast("string")) == gone[g_key]), "left_anti")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id").select("doc_id", "n_shingles", "component_id", "kept")
