import random
import re

import numpy as np
import pyarrow as pa

from tsloom.llm import neardup, tokens
from tsloom.llm.clusters import components
from tsloom.llm.common import Tables


def brute_sets(texts):
    out = []
    for t in texts:
        t = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(ids, texts, percent):
    sets = brute_sets(texts)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [(ids[i], len(sets[i]), min(groups[find(i)])) for i in range(len(ids))]


def test_words_equal_plain_splitting():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\t", "\x0b", "zz", " ", "Q"]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", " ", "x"]
    seen = {}
    for a, b, raw, at in tokens.blocks(pa.array(texts).slice(0)):
        h, ends = tokens.words(raw, at)
        for i in range(a, b):
            t = "".join(c.lower() if c.isascii() else c for c in texts[i] or "")
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
            got = h[ends[i - a] : ends[i - a + 1]].tolist()
            assert len(got) == len(w), (texts[i], len(got))
            for x, y in zip(w, got):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_blocks_split_long_batches(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 10)
    texts = pa.array(["x" * 25, "", "ab cd", None, "e" * 9, "f"])
    rows = [(a, b) for a, b, _, _ in tokens.blocks(texts)]
    assert rows[0][0] == 0 and rows[-1][1] == 6 and all(x[1] == y[0] for x, y in zip(rows, rows[1:]))
    assert sum(len(tokens.words(raw, at)[0]) for _, _, raw, at in tokens.blocks(texts)) == 5


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.doc_id for r in docs], [r.text for r in docs], 85)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.op8_near_duplicates(spark, sf_dir).collect())
    assert got == [(*w, w[0] == w[2]) for w in want]


def test_chains_groups_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    texts, w = [], list(base)
    for i in range(40):  # a chain: each is near the one before, the ends are not
        w = list(w)
        w[i * 3] = f"new{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 5 + ["short one", "short one", "short two", "", None, "  ", "a b c d e", "A b C d E"]
    ids = list(range(100, 100 + len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 AS node", "'x' AS sketch")
    got = sorted((r.id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == brute(ids, texts, 85)
    left = neardup.drop_near_duplicates(df, 85)
    assert left.columns == df.columns and left.count() == sum(a == c for a, _, c in got)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}}


def test_sketch_is_bottom_of_set(spark):
    df = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(500)))], "doc_id long, text string")
    r = neardup.sketches(df).first()
    assert r.n == 496 and len(r.sketch) == neardup.K and r.sketch == sorted(r.sketch) and np.all(np.array(r.sketch) >= 0)


def test_null_ids_and_one_id_with_two_texts(spark):
    rng = random.Random(9)
    some = lambda: [f"w{rng.randint(0, 9999)}" for _ in range(100)]
    a, b, c, d = (" ".join(some()) for _ in range(4))
    na, nb, nc = (" ".join([*t.split()[:-1], "other"]) for t in (a, b, c))
    rows = [(1, a), (None, na), (None, d), (5, b), (7, nb), (7, c), (8, nc)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 85).collect()}
    assert got == {(1, 1, True), (None, 1, False), (None, None, True), (5, 5, True), (7, 5, False), (7, 7, True), (8, 7, False)}
    left = {(r.doc_id, r.text) for r in neardup.drop_near_duplicates(df, 85).collect()}
    assert left == {(1, a), (None, d), (5, b), (7, c)}
