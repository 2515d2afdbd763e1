import math
from collections import defaultdict

from pyspark.sql import functions as F

from tsloom.llm import quality


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 4 <> 0")
    rows = quality.classify(docs, seen, F.col("source"), F.col("lang")).join(labels.where("doc_id % 4 = 0"), "doc_id").select("keep", "quality", "toxic", "posterior", "own").collect()
    junk = [r.keep for r in rows if r.quality == 0]
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    assert len(rows) > 60 and sum(clean) / len(clean) > 0.9, (sum(clean), len(clean))
    assert sum(junk) / len(junk) < 0.5, (sum(junk), len(junk))


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [(i, "good words here", "big", "a") for i in range(60)] + [(100 + i, "BAD!!! ###", "bad", "a") for i in range(60)] + [(200, "good words here", "tiny", "b"), (201, "BAD!!! ###", "tiny", "b"), (300, None, None, None), (301, "", "", None), (None, "good words here", "big", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, site string, area string").selectExpr("*", "1 AS Keep", "2 AS features", "3 AS mu")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)] + [(None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, F.col("site"), F.col("area"))
    assert [c for c in got.columns if c.lower() == "keep"] == ["keep"] and {"features", "mu"} <= set(got.columns)
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == len({r[0] for r in rows})
    assert by[0].keep and not by[100].keep and by[200].keep and not by[201].keep
    assert by[100].prior < by[201].prior < by[0].prior and by[100].prior < by[200].prior < by[0].prior
    assert got.count() == len(rows)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x", "s", "l")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.own for r in quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()] == [0.5]
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def plain_priors(rows):
    """{place: (prior, posterior)} of rows (host, path, own), in plain Python."""

    def concentration(s, n, n2, groups, free):
        phi = (s - free) / max(n - n2 / max(n, 1.0) - free, 1.0) if groups > 1 else 0.0
        phi = min(max(phi, 1e-4), 0.9999)
        return (1 - phi) / phi

    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, p, own in rows:
        for key, d in (((h, p), paths), (h, hosts)):
            d[key][0] += 1
            d[key][1] += own
    total = sum(n for n, _ in hosts.values())
    mu = sum(s for _, s in hosts.values()) / total
    k_host = concentration(sum(n * (s / n - mu) ** 2 / (mu * (1 - mu)) for n, s in hosts.values()), total, sum(n * n for n, _ in hosts.values()), len(hosts), len(hosts) - 1)
    theta = {h: (k_host * mu + s) / (k_host + n) for h, (n, s) in hosts.items()}
    x = sum(n * (s / n - theta[h]) ** 2 / (theta[h] * (1 - theta[h])) for (h, _), (n, s) in paths.items())
    k_path = concentration(x, total, sum(n * n / hosts[h][0] for (h, _), (n, _) in paths.items()) * total, len(paths), max(len(paths) - len(hosts), 0))
    out = []
    for h, p, own in rows:
        n, s = paths[h, p]
        prior = (k_path * theta[h] + s - own) / (k_path + n - 1)
        odds = own / (1 - own) * prior / (1 - prior) / (mu / (1 - mu))
        out.append((prior, odds / (1 + odds)))
    return out


def test_priors_and_posteriors_against_plain_python(spark, sf_dir):
    rows = quality.op1_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r, (prior, posterior) in zip(rows, plain_priors([(r.host, r.path, r.own) for r in rows])):
        assert math.isclose(r.prior, prior, rel_tol=1e-6) and math.isclose(r.posterior, posterior, rel_tol=1e-6, abs_tol=1e-9)
        assert r.keep == (r.posterior >= quality.THRESHOLD)


def test_clashing_columns(spark):
    names = ["site_h", "site_p", "site_n", "site_s", "site_theta", "in_host", "IN_OWN", "s_n", "__host", "host", "Prior", "h", "p", "features"]
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "BAD!!!", "s", "l") for i in range(8)], "doc_id long, text string, source string, lang string").selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, F.col("source"), F.col("lang"))
    r = got.first()
    assert r.host == "s" and r.path == "l" and all(r[n] == i for i, n in enumerate(names) if n not in ("host", "Prior"))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4 and kept.first().host == names.index("host")
