import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle  # noqa: E402

from tsloom.llm import mixing, urlrules  # noqa: E402
from tsloom.llm.registry import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, sf_dir, name):
    assert oracle.compare(spark, QUERIES[name], SQL[name], sf_dir) > 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "p", 100), ("a", "x", "q", 1000), ("a", "y", "p", 1000), ("b", "x", "p", 10), ("b", None, None, 5)], "domain string, lang string, source string, tokens long")
    weights = spark.createDataFrame([], mixing.WEIGHTS_SCHEMA)
    got = {(r.domain, r.lang, r.source): r.target for r in mixing.budgets(leaves, weights, F.lit(1000.0), 1).collect()}
    # b can give 15, so a gets 985; x and y share it; p of x is short, and q of x takes over
    assert got == {("a", "x", "p"): 100, ("a", "x", "q"): 392, ("a", "y", "p"): 492, ("b", "x", "p"): 10, ("b", None, None): 5}


def test_mix_of_odd_rows(spark):
    rows = [(i % 40, "w " * (i % 7), ["en", None][i % 2], f"s{i % 3}") for i in range(80)] + [(None, None, None, None), (1, "", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS whole", "2 AS Epochs", "3 AS place")
    weights = spark.createDataFrame([("d", "en", None, 3.0), ("d", "en", "s0", 0.0)], mixing.WEIGHTS_SCHEMA)
    out = mixing.mix(df, F.lit("d"), weights, share=0.5, max_epochs=3).collect()
    assert len(out) == len(rows) and all(r.whole == 1 and r.place == 3 for r in out)
    total = sum(r.n_tokens for r in out)
    drawn = sum(r.n_tokens * r.epochs for r in out)
    assert total * 0.5 - 40 < drawn <= total * 0.5
    assert all(r.epochs == 0 for r in out if r.source == "s0" and r.lang == "en" and r.n_tokens)
    assert mixing.mix(df.limit(0), F.lit("d"), weights).count() == 0


def test_urls(spark):
    urls = ["HTTP://A.Org/es/x", "https://example.org/es/1?q", "x://example.org/en/12", "x://www.EXAMPLE.org/en/2", "x://fr.com/fr/", "x://com/de/#a", "x://b.com", "nothing", None, "", "x://", "x://badexample.org/es/", "x://example.org?/es/", "a://b://org/", "x://example.org/es/1?q\nz"]
    want = ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, "org/", None, None, "example.org/es/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, urls[1]), (None, urls[0])], "page_id long, url string").selectExpr("*", "1 AS HOST", "2 AS short")
    rows = urlrules.judge_urls(df, urlrules.rules_frame(spark)).collect()
    assert len(rows) == len(urls) + 2
    by = {(r.page_id, r.url): r for r in rows}
    verdict = {x[0] + x[1]: x[2] for x in urlrules.RULES}
    for i, u in enumerate(urls):
        r = by[i, u]
        assert (r.rule, r.verdict) == (want[i], verdict.get(want[i], "allow")), u
    assert (by[13, urls[13]].host, by[13, urls[13]].path) == ("b:", "//org/") and by[None, urls[0]].rule == "org/"
    assert urlrules.judge_urls(df, urlrules.rules_frame(spark, [(None, "/", "block"), ("", "", "block")])).where("verdict <> 'allow'").count() == 0
    assert urlrules.judge_urls(df.limit(0), urlrules.rules_frame(spark)).count() == 0


def test_urls_with_clashing_columns(spark):
    names = ["rule_verdict", "best_host", "BEST_PATH", "n", "short", "digest", "expr", "rule_short", "host"]
    urls = spark.createDataFrame([("http://a.example.org/es/x",), ("http://b.com/fr/",), (None,)], "url string").selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    rows = urlrules.judge_urls(urls, urlrules.rules_frame(spark)).collect()
    assert all(r[n] == i for r in rows for i, n in enumerate(names[:-1]))
    assert {(r.host, r.verdict) for r in rows} == {("a.example.org", "block"), ("b.com", "allow"), ("", "allow")}


def test_rule_paths_without_a_slash_fit_nothing(spark):
    """A host and a path that together read like a longer host."""
    pages = spark.createDataFrame([(1, "http://www.example.org/x"), (2, "http://example.or/g/x"), (3, "http://example.org")], "page_id long, url string")
    rules = urlrules.rules_frame(spark, [("example.or", "g/", "block"), ("example", ".org", "block"), ("example.org/x", "", "block"), ("or", "/g", "block"), ("org", "", "allow")])
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge_urls(pages, rules, default="none").collect()}
    assert got == {1: ("org", "allow"), 2: ("or/g", "block"), 3: ("org", "allow")}
