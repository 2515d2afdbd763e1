"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression (Spark ML) on shape features and hashed words gives each document's own evidence: the probability
that a label would call it good (quality 1 and not toxic). Its sums by path, host and over all documents are grouped
aggregates. Each level is a beta distribution around its parent's mean: the moments of a level's rates give the concentration (Kleinman 1973),
so a host of few documents shrinks towards the global rate, and a path towards its host's posterior. A document's
posterior odds are its own odds times the odds of its path (less the document itself) over the global odds.

Nulls and odd input: null texts count as empty; null hosts and paths are values of their own. Rows are judged one by one,
so repeated rows, ties and null ids need no rule. An empty table gives an empty result; with no labels of one of
both kinds, every document's own evidence is 0.5. Labels may repeat; of one document's labels the worst counts. Other
input columns are kept; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.common import Tables, fresh, stored

#: Bound of labelled rows that the classifier is fitted on, chosen by a hash of the id.
MAX_LABELLED = 20_000
WORD_FEATURES = 1 << 13
#: Documents whose posterior is below are rejected.
THRESHOLD = 0.5
_EDGE = 1e-6


def shape(text: Column) -> list[Column]:
    """Rates that tell prose from shouting, symbol noise, tables and repetition."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / n
    some = lambda chars, least: share(chars) / (share(chars) + least)  # noqa: E731  rises steeply, so that a part of a text is seen too
    words = F.split(F.trim(text), r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")
    return [
        F.log1p(F.length(text)) / 10,
        some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.1),
        some("0123456789", 0.02),
        some("!?", 0.01),
        some("#$%&*@~^", 0.01),
        some("|<>{}[]=_\\/", 0.01),
        2 * share(" \t"),
        5 * share(".,;:"),
        F.length(text) / F.size(words) / 20,
        F.size(F.array_distinct(words)) / F.size(words),
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.log1p(F.size(lines)) / 5,
    ]


def featured(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with the feature vector `name`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, hashed, dense = fresh(docs, f"{name}_words", f"{name}_hashed", f"{name}_shape")
    out = docs.withColumn(words, F.split(F.lower(text), r"[^\p{L}]+")).withColumn(dense, array_to_vector(F.array(*[c.cast("double") for c in shape(text)])))
    out = VectorSizeHint(inputCol=dense, size=len(shape(text)), handleInvalid="optimistic").transform(out)
    out = HashingTF(binary=True, numFeatures=WORD_FEATURES, inputCol=words, outputCol=hashed).transform(out)
    return VectorAssembler(inputCols=[dense, hashed], outputCol=name).transform(out).drop(words, hashed, dense)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED):
    """The fitted model, or None without labels of both kinds."""
    good = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double")).alias("label"))
    n = good.count()
    if n > max_labelled:
        good = good.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(good, "id")
    sample = stored(featured(sample, "text", "features").select("features", "label"), "quality-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(maxIter=60, regParam=3e-4, standardization=False).fit(sample)


def _concentration(s: Column, n: Column, n2: Column, groups: Column, free: Column) -> Column:
    """Of a beta distribution: from s = sum n (rate - mean)^2 / (mean (1 - mean)), sums of n and n^2, and degrees of freedom."""
    phi = (s - free) / F.greatest(n - n2 / F.greatest(n, F.lit(1.0)) - free, F.lit(1.0))
    phi = F.least(F.greatest(F.when(groups > 1, phi).otherwise(0.0), F.lit(1e-4)), F.lit(0.9999))
    return (1 - phi) / phi


def priors(paths: DataFrame) -> DataFrame:
    """h, p, n, s, theta (of the host), mu, k_path of each path. paths: h, p (host and path, null or not), n, s (sum of own)."""
    hosts = paths.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    world = hosts.agg((F.sum("hs") / F.sum("hn")).alias("mu"))  # one row, as the other two aggregates below
    spread = hosts.crossJoin(F.broadcast(world)).agg(F.first("mu").alias("mu"), F.sum(F.col("hn") * (F.col("hs") / F.col("hn") - F.col("mu")) ** 2 / (F.col("mu") * (1 - F.col("mu")))).alias("x"), F.sum("hn").alias("n"), F.sum(F.col("hn") ** 2).alias("n2"), F.count("*").alias("g"))
    spread = spread.select("mu", F.col("g").alias("hosts"), _concentration(F.col("x"), F.col("n"), F.col("n2"), F.col("g"), F.col("g") - 1.0).alias("k_host"))
    hosts = hosts.crossJoin(F.broadcast(spread)).withColumn("theta", (F.col("k_host") * F.col("mu") + F.col("hs")) / (F.col("k_host") + F.col("hn")))
    placed = paths.join(hosts.select(F.col("h").alias("of"), "theta", "mu", "hn", "hosts"), F.col("h").eqNullSafe(F.col("of"))).drop("of")
    inner = placed.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("theta")) ** 2 / (F.col("theta") * (1 - F.col("theta")))).alias("x"), F.sum("n").alias("n"), F.sum(F.col("n") ** 2 / F.col("hn")).alias("within"), F.count("*").alias("g"), F.first("hosts").alias("hosts"))
    inner = inner.select(_concentration(F.col("x"), F.col("n"), F.col("within") * F.col("n"), F.col("g"), F.greatest(F.col("g") - F.col("hosts"), F.lit(0)).cast("double")).alias("k_path"))
    return placed.crossJoin(F.broadcast(inner)).select("h", "p", "n", "s", "theta", "mu", "k_path")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs with host, path, own (the classifier's probability), prior (of the path, without the document), posterior and keep.

    Without keep_text, the text is left out, and each text is scored once: the other columns are stored between the two
    passes. With it, texts are scored in both passes, as that takes no disk."""
    made = ["host", "path", "own", "prior", "posterior", "keep"]
    model = train(docs, labels, id_col, text_col)
    h, p, own = fresh(docs, "in_host", "in_path", "in_own")
    base = docs.withColumns({h: host, p: path})
    if model is None:
        scored = base.withColumn(own, F.lit(0.5))
    else:
        x, raw, prob, pred = fresh(base, "features", "raw_prediction", "class_probability", "class_prediction")
        model = model.setFeaturesCol(x).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
        scored = model.transform(featured(base, text_col, x)).withColumn(own, vector_to_array(prob)[1]).drop(x, raw, prob, pred)
    scored = scored.withColumn(own, F.least(F.greatest(own, F.lit(_EDGE)), F.lit(1 - _EDGE)))
    scored = scored.drop(*[c for c in docs.columns if c.lower() in made])
    if not keep_text:
        scored = stored(scored.drop(text_col), "quality-scores")
    tables = Tables(docs.sparkSession)
    paths = scored.groupBy(F.col(h).alias("h"), F.col(p).alias("p")).agg(F.count("*").cast("double").alias("n"), F.sum(own).alias("s"))
    paths = tables.store(paths, "quality-paths")
    sites = priors(paths)
    names = fresh(scored, *[f"site_{c}" for c in sites.columns])
    sites = stored(sites.toDF(*names), "quality-sites")
    tables.drop()
    s_h, s_p, n, s, theta, mu, k_path = (sites[c] for c in names)
    out = scored.join(sites, scored[h].eqNullSafe(s_h) & scored[p].eqNullSafe(s_p))
    prior = (k_path * theta + s - F.col(own)) / (k_path + n - 1)
    logit = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.least(F.greatest(c, F.lit(_EDGE)), F.lit(1 - _EDGE))
    posterior = 1 / (1 + F.exp(-(logit(F.col(own)) + logit(inside(prior)) - logit(inside(mu)))))
    out = out.withColumns({"prior": prior, "posterior": posterior}).withColumn("keep", F.col("posterior") >= threshold)
    return out.drop(*names).withColumnsRenamed({h: "host", p: "path", own: "own"})


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """docs that the classifier does not reject. Documents without URLs have their source for a host and their language for a path."""
    h, p = fresh(docs, "own_host", "own_path")
    base = docs.withColumns({h: F.col("source") if host is None else host, p: F.col("lang") if path is None else path})
    aside = dict(zip(docs.columns, fresh(base, *[f"kept_{c}" for c in docs.columns]), strict=True))  # classify has names of its own
    good = classify(base.withColumnsRenamed(aside), labels.withColumnRenamed("doc_id", aside["doc_id"]), F.col(h), F.col(p), aside["doc_id"], aside["text"]).where("keep")
    return good.select(*[F.col(a).alias(c) for c, a in aside.items()])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and language stand for host and path, as `documents` has no URL."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, F.col("source"), F.col("lang"), keep_text=False).select("doc_id", "host", "path", "own", "prior", "posterior", "keep")
