"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source carries relative weights. The token budget is split from the root down: among the
children of a node by weight, but no child gets more than its whole subtree can give (its tokens times max_epochs), and
what a child cannot use goes to its siblings by weight. As a node keeps all it was given while its own subtree can use
it, a shortage moves to siblings first and to the siblings of an ancestor only then. A leaf's budget is met by whole
epochs and a prefix of one more epoch, whose order is a seeded hash; the prefix is the longest one that stays within the budget.

Only leaf totals go through windows over siblings. The prefix of a leaf, however large, is found by sums over hash
ranges (two levels of 256), so no task holds a leaf's documents.

Nulls and odd input: a null domain, language or source is a value of its own; null and wordless texts have no tokens,
take no budget and are in every epoch of their leaf (also in the last where their place is within the prefix). Repeated
ids are ordered by a hash of their text; fully equal rows that straddle the end of a prefix are taken together with it
or left together. Weights default to 1; at 0 or less a subtree gets nothing. An empty table gives an empty result.
Other input columns are kept; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tsloom.llm.common import fresh, stored

SEED = 17
MAX_EPOCHS = 4
#: Budget as a share of all tokens.
SHARE = 0.5
DOMAINS = ["web", "books", "forum"]
#: domain, language, source, weight; null where the weight is of an inner node.
WEIGHTS = [
    ("web", None, None, 0.5),
    ("books", None, None, 0.3),
    ("forum", None, None, 0.2),
    *[(d, "en", None, 6.0) for d in DOMAINS],
    *[(d, x, None, 2.0) for d in DOMAINS for x in ("de", "fr")],
    ("web", "es", None, 4.0),
    ("web", "en", "src0", 2.0),
]
LEAF = ["domain", "lang", "source"]
WEIGHTS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LEAF] + [T.StructField("weight", T.DoubleType())])


def domain_of(source: Column) -> Column:
    """The query's domains: by the number at the end of the source's name, in turn; none: the first."""
    n = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (n % len(DOMAINS) + 1).cast("int"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weighed(nodes: DataFrame, weights: DataFrame, depth: int) -> DataFrame:
    """nodes with w, the weight of the node that the first `depth` columns of LEAF name."""
    on = LEAF[:depth]
    own = weights.where(F.col(on[-1]).isNotNull())
    for c in LEAF[depth:]:
        own = own.where(F.col(c).isNull())
    own = own.groupBy(*on).agg(F.max("weight").alias("weight")).withColumnsRenamed({c: f"w_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & (nodes[c] == own[f"w_{c}"])
    return nodes.join(own, cond, "left").withColumn("w", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0))).drop("weight", *[f"w_{c}" for c in on])


def _filled(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """nodes with alloc: the parent's budget, split by w with no more than cap for each."""
    nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0)).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0))
    kin = Window.partitionBy(*[F.col(c) for c in parent] or [F.lit(0)])
    line = kin.orderBy("ratio", F.col(key).asc_nulls_first())
    before = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing))
    full = nodes.withColumn("full", before + F.col("ratio") * onward <= F.col("budget") * (1 + 1e-12))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(kin), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(kin)
    return full.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(rest / open_w * F.col("w"))).drop("ratio", "full")


def budgets(leaves: DataFrame, weights: DataFrame, budget: Column, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with target, the tokens to draw from each."""
    leaves = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    # a subtree of weight 0 gives nothing, so capacities are summed after the weights below are known
    lang_level = _weighed(leaves, weights, 3).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0))
    langs = _weighed(lang_level.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")), weights, 2).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0))
    domains = _weighed(langs.groupBy("domain").agg(F.sum("cap").alias("cap")), weights, 1)
    total = leaves.agg(budget.alias("budget"))  # one row
    d = _filled(domains.crossJoin(F.broadcast(total)), [], "domain").select(F.col("domain").alias("p_domain"), F.col("alloc").alias("budget"))
    n = langs.join(d, langs["domain"].eqNullSafe(d["p_domain"]))
    n = _filled(n, ["domain"], "lang").select(F.col("domain").alias("p_domain"), F.col("lang").alias("p_lang"), F.col("alloc").alias("budget"))
    s = lang_level.join(n, lang_level["domain"].eqNullSafe(n["p_domain"]) & lang_level["lang"].eqNullSafe(n["p_lang"]))
    return _filled(s, ["domain", "lang"], "source").select(*LEAF, "tokens", F.floor(F.col("alloc") + 1e-4).cast("long").alias("target"))


def _place(epoch: Column, doc_id: Column, seed: int) -> Column:
    """60 bits of a hash that orders an epoch's documents."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, domain: Column, weights: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (with lang and source) with domain, n_tokens and epochs: how often each document is in the mixture."""
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("domain", "n_tokens", "epochs")]).withColumn("domain", domain).withColumn("n_tokens", n_tokens(F.col(text_col)))
    small = stored(base.select(*LEAF, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), "n_tokens"), "mixing-tokens")
    leaves = small.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, weights, F.sum("tokens") * share, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens"))
    plan = stored(plan.select(*[F.col(c).alias(f"p_{c}") for c in LEAF], "whole", "rest"), "mixing-plan", 1)
    p_leaf = [f"p_{c}" for c in LEAF]

    def matched(a: DataFrame, a_cols: list[str], b: DataFrame, b_cols: list[str]) -> Column:
        cond = F.lit(True)
        for x, y in zip(a_cols, b_cols, strict=True):
            cond = cond & a[x].eqNullSafe(b[y])
        return cond

    open_ = plan.where("rest > 0")
    placed = small.join(open_, matched(small, LEAF, open_, p_leaf)).withColumn("place", _place(F.col("whole") + 1, F.col("id"), seed)).withColumn("low", F.lit(0).cast("long")).withColumn("left", F.col("rest"))
    for bits in (52, 44):
        sums = placed.groupBy(*p_leaf, "left", F.shiftright("place", bits).alias("range")).agg(F.sum("n_tokens").alias("n"))
        line = Window.partitionBy(*p_leaf).orderBy("range")
        sums = sums.withColumn("upto", F.sum("n").over(line))
        split = sums.where(F.col("upto") > F.col("left")).groupBy(*p_leaf).agg(F.min(F.struct("range", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))).alias("s"))
        split = split.select(*[F.col(c).alias(f"s_{c}") for c in p_leaf], F.col("s.range").alias("s_range"), F.col("s.left").alias("s_left"))
        cond = matched(placed, p_leaf, split, [f"s_{c}" for c in p_leaf]) & (F.shiftright(placed["place"], bits) == split["s_range"])
        placed = placed.join(split, cond).withColumn("left", F.col("s_left")).withColumn("low", F.shiftleft("s_range", bits)).select(*placed.columns)
    inside = placed.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy(*p_leaf).orderBy("place", "id", "text_hash")))
    cuts = inside.groupBy(*p_leaf).agg(F.max("low").alias("low"), F.max(F.when(F.col("upto") <= F.col("left"), F.struct("place", "id", "text_hash"))).alias("cut"))
    cuts = cuts.withColumnsRenamed({c: f"c_{c}" for c in p_leaf})
    plan = plan.join(cuts, matched(plan, p_leaf, cuts, [f"c_{c}" for c in p_leaf]), "left").select(*p_leaf, "whole", "rest", "low", "cut")
    names = fresh(base, *[f"mix_{c}" for c in plan.columns])
    plan = stored(plan.toDF(*names), "mixing-cuts", 1)
    out = base.join(plan, matched(base, LEAF, plan, names[:3]))
    whole, rest, low, cut = (F.col(c) for c in names[3:])
    here = _place(whole + 1, F.col(id_col), seed)
    key = F.struct(here.alias("place"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    part = (rest > 0) & ((here < low) | F.coalesce(key <= cut, F.lit(False)))
    return out.withColumn("epochs", whole + F.when(part, 1).otherwise(0)).drop(*names)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, domain_of(F.col("source")), spark.createDataFrame(WEIGHTS, WEIGHTS_SCHEMA)).select("doc_id", "domain", "lang", "source", "n_tokens", "epochs")


def _fill_sql(nodes: str, parent: str, key: str) -> str:
    """DuckDB SQL of the same split, over a relation with key, parent, w, cap and budget."""
    return f"""SELECT *, CASE WHEN full_ THEN cap ELSE (budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY {parent}), 0)) / sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY {parent}) * w END AS alloc
  FROM (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + cap / w * sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget * (1 + 1e-12) AS full_ FROM ({nodes}))"""


def _sql() -> str:
    values = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in WEIGHTS)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, {DOMAINS!r}[coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % {len(DOMAINS)} + 1] AS domain, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
w(wd, wl, ws, weight) AS (VALUES {values}),
s AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, sum(n_tokens)::DOUBLE * {MAX_EPOCHS} AS cap FROM t GROUP BY ALL),
s3 AS (SELECT s.*, coalesce(weight, 1)::DOUBLE AS w FROM s LEFT JOIN w ON wd = domain AND wl = lang AND ws = source),
s2 AS (SELECT x.*, coalesce(weight, 1)::DOUBLE AS w FROM (SELECT domain, lang, sum(cap) AS cap FROM s3 GROUP BY ALL) x LEFT JOIN w ON wd = domain AND wl = lang AND ws IS NULL),
s1 AS (SELECT x.*, coalesce(weight, 1)::DOUBLE AS w, (SELECT sum(tokens) * {SHARE}::DOUBLE FROM s) AS budget FROM (SELECT domain, sum(cap) AS cap FROM s2 GROUP BY ALL) x LEFT JOIN w ON wd = domain AND wl IS NULL),
a1 AS ({_fill_sql("SELECT * FROM s1", "1", "domain")}),
a2 AS ({_fill_sql("SELECT s2.*, alloc AS budget FROM s2 JOIN a1 USING (domain)", "domain", "lang")}),
a3 AS ({_fill_sql("SELECT s3.*, alloc AS budget FROM s3 JOIN a2 USING (domain, lang)", "domain, lang", "source")}),
p AS (SELECT domain, lang, source, CAST(floor(floor(alloc + 1e-4) / tokens) AS BIGINT) AS whole, CAST(floor(alloc + 1e-4) AS BIGINT) - CAST(floor(floor(alloc + 1e-4) / tokens) AS BIGINT) * tokens AS rest FROM a3),
o AS (SELECT t.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('{SEED}:' || (whole + 1) || ':' || doc_id), 1, 15))::BIGINT, doc_id) AS upto FROM t JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS epochs FROM o
"""


SQL = _sql()
