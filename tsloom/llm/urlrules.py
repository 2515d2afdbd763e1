"""URL filters: host-suffix and path-prefix expressions, matched to rules by short hash prefixes.

Each URL becomes a set of expressions: every suffix of its host at a label boundary, joined with every prefix of its
path that is as long as some rule's path. An equi-join on the first 32 bits of each expression's SHA-256 finds
candidate rules, equality of the full digests confirms them, and the longest confirmed rule decides.

Nulls and odd input: a null URL, or one without "://", has an empty host and path and fits no rule. Repeated rows and
repeated or null ids are judged row by row. An empty table gives an empty result. Input columns are kept; the four
result columns replace input columns of the same name. Null or empty rule hosts fit nothing, nor do paths that do not begin with "/"; of two equal rules with
different verdicts, block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.common import ascii_lower, fits, fresh

#: Rules of the query: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: The join broadcasts the rules only up to this many; beyond, both sides are shuffled.
MAX_BROADCAST_RULES = 20_000


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z lower-cased; "" for null or no "://"."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of host-suffix + path-prefix strings."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with the columns host, path, rule (null: none fits) and verdict (default where no rule fits)."""
    # a URL's path is empty or begins with "/", so no other rule's path fits; and the first "/" of a rule ends its host
    fitting = F.coalesce("path", F.lit("")).rlike("^(/|$)") & ~F.contains("host", F.lit("/"))
    rules = (
        rules.where((F.coalesce("host", F.lit("")) != "") & F.col("verdict").isNotNull() & fitting)
        .select(F.concat(ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))).alias("rule"), F.length(F.coalesce("path", F.lit(""))).alias("n"), "verdict")
        .groupBy("rule", "n")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())  # as many as there are lengths of paths, not rules
    out = urls.drop(*[c for c in urls.columns if c.lower() in ("host", "path", "rule", "verdict")])
    out = out.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not lengths:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    n, short, digest, b_host, b_path, b_verdict = fresh(out, "n", "short", "digest", "best_host", "best_path", "rule_verdict")
    near = F.broadcast if fits(rules, MAX_BROADCAST_RULES) else (lambda x: x)
    asked = out.select("host", "path").distinct().where(F.col("host") != "")
    asked = asked.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("expr"))
    asked = asked.withColumn(digest, F.sha2("expr", 256)).withColumn(short, F.substring(digest, 1, 8))
    hit = asked.join(near(rules.withColumnsRenamed({"short": "rule_short", "digest": "rule_digest"})), F.col(short) == F.col("rule_short"))
    best = (
        hit.where((F.col(digest) == F.col("rule_digest")) & (F.col("expr") == F.col("rule")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias(n))
        .select(F.col("host").alias(b_host), F.col("path").alias(b_path), F.col(f"{n}.rule").alias("rule"), F.col(f"{n}.verdict").alias(b_verdict))
    )
    joined = out.join(best, (out["host"] == best[b_host]) & (out["path"] == best[b_path]), "left")
    return joined.withColumn("verdict", F.coalesce(b_verdict, F.lit(default))).drop(b_host, b_path, b_verdict)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(strpos(url, '://'), 0) AS i0 FROM pages),
q AS (SELECT page_id, CASE WHEN i0 = 0 THEN '' ELSE substr(url, i0 + 3) END AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rn FROM q),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT h.*, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY rn ORDER BY length(rhost || rpath) DESC) AS k
  FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
