"""Filter interaction audit by incremental retraction streaming.

Five filters are applied to documents in all 120 orders. What an order removes depends on each document's failing filters alone, so
counters of documents by part and mask of failing filters are enough for every order; the counters are kept by a stream.

Filters A to D look at one text. E fails a document whose text a smaller id has too, anywhere in the table, so its verdict can
change as files come in: all files are read as available-now micro-batches, and a state keyed by the text (128 bits of its SHA-256)
holds the smallest id and where the documents of that id are counted. When a smaller id arrives, a document counted as first is
taken out of its counter and put into the one with E. Some hundred texts share one entry of Spark's state store, a bucket, as a call
for each text would cost more than all else; the number of buckets grows with the rows. A stream's batch writes its changes as a
file of its own, named by the batch, so that one done again after a failure replaces itself; the counters are the sums of changes.

Before the exchange a task adds up the documents of one text, part and labels, and their smallest id: a text of a third of all rows
costs each task a few rows. A state's size grows with the languages and labels of one id, not with the copies. Many texts call for
Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass), which is left to the session.

Odd input: null texts are empty, null languages count as the part "", null ids are neither smaller nor larger than others: their
documents do not fail E, nor do they make others fail. Rows of the smallest id of a text do not fail E, if there are several.
Repeated labels of an id count once, as 1 if any is 1. Ids are whole numbers. Empty tables give no parts. Other columns are left out.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsloom.llm.common import Tables, delete, shared_dir

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
#: Texts that share one call of the state's function, about; their number is that of the rows divided by this.
A_BUCKET = 512
#: Micro-batches that the files of a run are dealt to, at most.
BATCHES = 8
_E = 1 << FILTERS.index("E")


def masks(docs: DataFrame) -> DataFrame:
    """digest of the text, doc_id, part and mask (bits of A to D) of each document."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("_t"))
    d = d.withColumn("_w", words).withColumn("_n", F.size("_w"))
    capitals = F.length(F.regexp_replace("_t", "[^A-Z]", ""))
    fails = [
        F.col("_n") < LEAST_WORDS,
        100 * F.size(F.array_distinct("_w")) < LEAST_DISTINCT * F.col("_n"),
        100 * capitals > MOST_CAPITALS * F.length("_t"),
        F.col("_t").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return d.select(F.substring(F.unhex(F.sha2("_t", 256)), 1, 16).alias("digest"), "doc_id", "part", mask.cast("int").alias("mask"))


_KEYS = ["digest", "part", "mask", "good", "toxic"]
_SUMS = pa.schema([("digest", pa.binary()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("known", pa.int32()), ("doc_id", pa.int64()), ("at_least", pa.int64()), ("others", pa.int64())])


def _added_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text, part and labels of a batch: the smallest id, how many rows have it, and how many have others; null ids apart (known 0)."""
    for b in batches:
        t = pa.table(b)
        t = t.append_column("known", pc.cast(pc.is_valid(t["doc_id"]), pa.int32()))
        t = t.set_column(t.column_names.index("doc_id"), "doc_id", pc.fill_null(t["doc_id"], 0))
        each = t.group_by([*_KEYS, "known", "doc_id"]).aggregate([([], "count_all")]).sort_by([*[(k, "ascending") for k in [*_KEYS, "known", "doc_id"]]])
        firsts = each.group_by([*_KEYS, "known"], use_threads=False).aggregate([("doc_id", "min"), ("count_all", "first"), ("count_all", "sum")])
        out = [*[firsts[k] for k in [*_KEYS, "known"]], firsts["doc_id_min"], firsts["count_all_first"], pc.subtract(firsts["count_all_sum"], firsts["count_all_first"])]
        yield from pa.table([c.cast(f.type) for c, f in zip(out, _SUMS, strict=True)], schema=_SUMS).to_batches()


_CHANGE = "part string, mask int, good int, toxic int, delta long"
#: Of a bucket's texts: digest, mask and smallest id; and places of the documents of that id: the text's number, part and labels, how many.
_STATE = "digests array<binary>, masks array<int>, leasts array<long>, texts array<int>, parts array<string>, goods array<int>, toxics array<int>, counts array<long>"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by new documents of a bucket's texts. The state has each text's smallest id, and how many documents of that id are counted where."""
    texts: dict[bytes, list] = {}  # digest: mask, smallest id, {(part, good, toxic): documents}
    if state.exists:
        digests, text_masks, leasts, *places = state.get
        texts = {bytes(d): [m, i, {}] for d, m, i in zip(digests, text_masks, leasts, strict=True)}
        by_number = list(texts.values())
        for number, part, good, toxic, n in zip(*places, strict=True):
            by_number[number][2][part, good, toxic] = n
    changes: Counter = Counter()
    for frame in frames:
        for digest, part, mask, good, toxic, known, doc_id, at_least, others in zip(*[frame[c].tolist() for c in _SUMS.names], strict=True):
            if not known:
                changes[part, mask, good, toxic] += at_least
                continue
            text = texts.get(digest)
            if text is None:
                text = texts[digest] = [mask, doc_id, {}]
            elif doc_id < text[1]:
                for (p, g, t), n in text[2].items():  # no longer the first
                    changes[p, mask, g, t] -= n
                    changes[p, mask | _E, g, t] += n
                text[1:] = [doc_id, {}]
            if doc_id == text[1]:
                text[2][part, good, toxic] = text[2].get((part, good, toxic), 0) + at_least
                changes[part, mask, good, toxic] += at_least
                changes[part, mask | _E, good, toxic] += others
            else:
                changes[part, mask | _E, good, toxic] += at_least + others
    if texts:
        places = [(k, *where, n) for k, (_, _, counted) in enumerate(texts.values()) for where, n in counted.items()]
        state.update(([*texts], [m for m, _, _ in texts.values()], [i for _, i, _ in texts.values()], *map(list, zip(*places, strict=True))))
    told = [(*where, delta) for where, delta in changes.items() if delta]
    yield pd.DataFrame(told, columns=["part", "mask", "good", "toxic", "delta"])


def counters(spark: SparkSession, docs_path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """part, mask, good, toxic, n: documents by failing filters and labels, from a stream over the files of docs_path."""
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    still = spark.read.parquet(docs_path)
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    tables = Tables(spark)
    known = tables.store(known.where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS bigint) AS doc_id", "coalesce(good, 0) AS good", "coalesce(toxic, 0) AS toxic"), "audit-labels")
    spark.createDataFrame([], _CHANGE).write.parquet(f"{path}/changes/batch=-1")
    files = still.inputFiles()
    a_batch = max(1, math.ceil(len(files) / batches))
    single = len(files) == 1 and files[0].rsplit("/", 1)[-1] == docs_path.rstrip("/").rsplit("/", 1)[-1]
    source = f"{docs_path[:-1]}[{docs_path[-1]}]" if single else docs_path  # a stream takes a folder, or a pattern for one file
    stream = spark.readStream.schema(still.schema).option("maxFilesPerTrigger", a_batch).parquet(source)
    told = masks(stream).join(known, "doc_id", "left")
    told = told.select("digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "doc_id")
    sums = told.mapInArrow(_added_up, from_arrow_schema(_SUMS))
    buckets = max(1, still.count() // A_BUCKET)  # from the files' footers
    changes = sums.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(_follow, _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("delta").alias("delta")).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    changes.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    tables.drop()
    delete(spark, f"{path}/checkpoint")  # the state; the changes alone are read from here on
    kept = spark.read.schema(_CHANGE).parquet(f"{path}/changes")
    return kept.groupBy("part", "mask", "good", "toxic").agg(F.sum("delta").alias("n")).where("n <> 0")


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and its counters, from part, mask, good, toxic, n (at most 128 rows a part)."""
    bit = lambda letters: F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: a + F.when(c != "", F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord("A"))).otherwise(0))
    orders = F.explode(F.array(*[F.lit(o) for o in ORDERS]))
    steps = counts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumns({"bit": bit(F.substring("filter_order", F.col("step"), F.lit(1))), "before": bit(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c, what: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(what)
    out = steps.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone, "kept"),
        total(fails & ~gone, "removed"),
        total(fails & gone, "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(fails & ~gone & (F.col("good") == 1), "good_lost"),
        total(fails & ~gone & (F.col("toxic") == 1), "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")  # 120 rows


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(counters(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS INT) AS mask FROM t LEFT JOIN l USING (doc_id)),
h AS (SELECT part, mask, good, toxic, count(*) AS n FROM d GROUP BY ALL),
f(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.c || q.c || r.c || s.c || u.c AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM f p, f q, f r, f s, f u WHERE p.b + q.b + r.b + s.b + u.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
x AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
y AS (SELECT part, filter_order, step, bit, n, good, toxic, mask & bit <> 0 AS fails, mask & before <> 0 AS gone, mask = bit AS alone FROM h, x),
z AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
  coalesce(sum(n) FILTER (fails AND NOT gone AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic = 1), 0) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM z
"""
