import hashlib
import random
import re

from tsloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items, window=10):
    """{id: (words, hit words, ids of items)} by comparing all windows."""
    wins = {}
    for i, t in items:
        ws = words(t)
        n = min(window, len(ws))
        for a in range(len(ws) - n + 1 if ws else 0):
            wins.setdefault(tuple(ws[a : a + n]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = {}
    for i, t in docs:
        ws, hit, ids = words(t), set(), set()
        for n in sizes:
            for a in range(len(ws) - n + 1):
                if tuple(ws[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    ids |= wins[tuple(ws[a : a + n])]
        out[i] = (len(ws), len(hit), ids)
    return out


def test_query_against_windows(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(docs, items)
    rows = decontam.op6_decontam(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, ids = want[r.doc_id]
        told = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), told, hit > 0)


def test_random_texts_short_items_and_blocks(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda k: " ".join(rng.choice("abcd") for _ in range(k))
    items = [(i, some(rng.choice([0, 1, 3, 4, 5, 9, 14, 70]))) for i in range(3, 25)] + [(90, None), (91, "A b, C!"), (None, "d d d d"), (91, "A b, C!")]
    docs = [(i, some(rng.randint(0, 60))) for i in range(120)] + [(500, None), (501, ""), (502, "É é1")]
    want = brute(docs, items, 5)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS hit_spans", "2 AS Item_Ids")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 AS doc_id")
    for words_a_block in (decontam.BLOCK_WORDS, 20):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words_a_block)
        got = {r.doc_id: (r.n_words, sum(r.hit_spans[1::2]) - sum(r.hit_spans[::2]), {int(x) for x in r.item_ids}) for r in decontam.find_items(d, b, window=5).collect()}
        assert got == {i: (n, h, {x for x in ids if x is not None}) for i, (n, h, ids) in want.items()}
    assert decontam.find_items(d.limit(0), b).count() == 0
    assert all(not r.hit_spans for r in decontam.find_items(d, b.limit(0)).collect())


def test_cut():
    assert decontam.cut("One two, THREE four.", [1, 3]) == "One \n four."
    assert decontam.cut("É a b", [0, 1]) == "\n a b"


def test_decontaminate_nulls_clashing_names_and_blocks(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    clean = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, clean), (2, None), (3, ""), (4, f"{clean} {item}. {clean}"), (5, item.upper()), (6, f"{clean}\n{item}"), (None, f"{item} {clean} {clean}"), (4, f"{clean} {item}. {clean}")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("7 AS Hit_Spans", "doc_id", "text", "'x' AS n_words", "array(doc_id) AS item_ids")
    b = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    for words_a_block in (decontam.BLOCK_WORDS, 11):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words_a_block)
        out = decontam.decontaminate(d, b)
        assert out.columns == d.columns and "BatchEvalPython" not in out._jdf.queryExecution().toString()
        rows = out.collect()
        assert all(r.Hit_Spans == 7 and r.n_words == "x" and r.item_ids == [r.doc_id] for r in rows)
        got = sorted(((r.doc_id, r.text) for r in rows), key=str)
        want = [(1, clean), (2, None), (3, ""), (4, f"{clean} \n. {clean}"), (4, f"{clean} \n. {clean}"), (6, f"{clean}\n\n"), (None, f"\n {clean} {clean}")]
        assert got == sorted(want, key=str)
    assert decontam.decontaminate(d.limit(0), b).count() == 0
    assert decontam.decontaminate(d, b.limit(0)).count() == len(docs)


def test_very_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"v{i % 977}" for i in range(200_000))
    d = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, long)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(d, b).collect()}
    assert got == {1: f"{long} \n {long}", 2: long}
