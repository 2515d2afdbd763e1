import itertools
import random
import re

import oracle

from tsloom.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """{(part, order, step): counters} document by document; docs: (doc_id, lang, text)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fed = []
    for i, lang, text in docs:
        text = text or ""
        ws = WORD.findall(text)
        fails = ""
        fails += "A" * (len(ws) < 100)
        fails += "B" * (100 * len(set(ws)) < 80 * len(ws))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
        fails += "D" * bool(set(text) & set("#$%&*|"))
        fails += "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in docs))
        fed.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in fed}:
        mine = [f for f in fed if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                failing = [f for f in mine if c in f[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(f[1] == c for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def written(spark, folder, files):
    """Documents in files of their own, the first written first."""
    for f in files:
        df = spark.createDataFrame(f, "doc_id long, lang string, text string").selectExpr("*", "'x' AS part", "1 AS mask", "2 AS good", "3 AS digest", "4 AS _t")
        df.coalesce(1).write.mode("append").parquet(folder)


def test_smaller_ids_that_come_later(spark, tmp_path):
    rng = random.Random(7)
    long = " ".join(f"w{k}" for k in range(120))
    texts = [None, "", "short", long, long + " #", "ABC DEF", "a a a a", long.upper(), f"{long} {long}"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(["en", "de", None, ""]), rng.choice(texts)) for _ in range(150)]
    docs.sort(key=lambda d: -1 if d[0] is None else -d[0])  # large ids first: nearly each file takes something back
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1)]
    folder = str(tmp_path / "documents.parquet")
    written(spark, folder, [docs[a : a + 30] for a in range(0, 150, 30)])
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(docs, labels)
    for batches in (1, 5):
        assert rows_of(audit.audit(audit.counters(spark, folder, told, batches))) == want
    assert len(want) == 3 * 120 * 5


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "documents.parquet")
    written(spark, folder, [[]])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.counters(spark, folder, none)).count() == 0


def test_very_long_text_and_many_copies(spark, tmp_path):
    docs = [(k, "en", "copy") for k in range(3000)] + [(5000, "en", "word " * 200_000)]
    folder = str(tmp_path / "documents.parquet")
    written(spark, folder, [docs[1500:], docs[:1500]])
    got = rows_of(audit.audit(audit.counters(spark, folder, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))))
    assert got["en", "EABCD", 1] == [2, 2999, 0, 0, 0, 0, got["en", "EABCD", 1][-1]]
    assert got["en", "ABCDE", 1][:2] == [1, 3000] and got["en", "ABCDE", 1][4] == 1


def test_query(spark, sf_dir):
    assert oracle.compare(spark, audit.op11_filter_audit, audit.SQL, sf_dir) > 0
