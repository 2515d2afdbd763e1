import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tsloom.llm import lm


def tokens(t):
    t = "".join(c.lower() if c.isascii() else c for c in t or "")
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x] + [None]


def brute(docs):
    """{place: (held out, tokens, known, N, base, score)} by plain counting."""
    words, pairs, before, triples, heads = Counter(), Counter(), Counter(), Counter(), Counter()
    rows = [(zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, tokens(t)) for i, t in docs]
    for held, ws in rows:
        if not held:
            words.update(ws)
            pairs.update(zip([0, *ws[:-1]], ws))
            before.update([0, *ws[:-1]])
            triples.update(zip([0, *ws[:-2]], ws, ws[1:]))
            heads.update(zip([0, *ws[:-2]], ws[:-1]))
    n, v = sum(words.values()), len(words)
    p1 = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda a, b: (pairs[a, b] + lm.MU[0] * p1(b)) / (before[a] + lm.MU[0])
    p3 = lambda u, v, w: (triples[u, v, w] + lm.MU[1] * p2(v, w)) / (heads[u, v] + lm.MU[1])
    out = []
    for held, ws in rows:
        s = math.log10(p2(0, ws[0])) + sum(math.log10(p3(u, v, w)) for u, v, w in zip([0, *ws[:-2]], ws, ws[1:]))
        out.append((held, len(ws), sum(words[w] > 0 for w in ws), n, sum(math.log10(p1(w)) for w in ws), s))
    return out


def check(got, want):
    assert got[:4] == want[:4]
    assert math.isclose(got[4], want[4], rel_tol=1e-9, abs_tol=1e-9)
    assert abs(got[5] - want[5]) <= 0.03 * want[1]  # 8-bit codes


def test_query_against_plain_counts(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = brute(docs)
    got = {r.doc_id: tuple(r)[1:] for r in lm.op9_lm_score(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, _), w in zip(docs, want):
        check(got[i], w)
    held = [(got[i][4], got[i][5]) for (i, _), w in zip(docs, want) if w[0] and w[1] > 50]
    assert sum(s for _, s in held) > sum(b for b, _ in held)  # the model predicts unseen documents better


@pytest.mark.parametrize("shard_tokens", [10, 1000])
def test_odd_rows_and_small_blocks(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 40)
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)  # with few tokens to a shard all contexts are frequent and dealt out, else hardly any
    docs = [(1, None), (2, ""), (2, "a b a b"), (3, "A  b\nc" * 30), (None, "x y"), (5, "a b c"), (6, "a b"), (7, "é É"), (8, "b a " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS data").repartition(2)
    got = sorted((tuple(r) for r in lm.score(df).collect()), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(docs, brute(docs))), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2]))):
        assert g[0] == w[0]
        check(g[1:], w[1:])
    assert lm.score(df.limit(0)).count() == 0


def test_elias_fano_round_trip_and_successor(tmp_path):
    rng = random.Random(4)
    for n, top in ((1, 1), (5, 10), (1000, 1 << 40), (3000, 3500), (100, 1 << 62)):
        x = np.sort(np.array([rng.randrange(top) for _ in range(n)], np.uint64))
        ef = lm.EliasFano.view(lm.EliasFano.encode(x))
        assert (ef.access(np.arange(n)) == x).all()
        ask = np.array([rng.randrange(top) for _ in range(200)] + x[:50].tolist(), np.uint64)
        at, hit = ef.successor(np.zeros(len(ask), np.int64), np.full(len(ask), n), ask)
        assert (at == np.searchsorted(x, ask)).all() and (hit == np.isin(ask, x)).all()
    contexts = np.array([3, 9, 2**63 + 1], np.uint64)
    packed = lm.Trie.pack(contexts, np.array([2, 1, 3]), np.array([1, 2**32 - 1, 0, 5, 6, 7], np.uint32), np.array([-1.0, -2, -3, -4, -5, -6]))
    path = tmp_path / "trie"
    path.write_bytes(packed)
    for t in (lm.Trie.mapped(packed), lm.Trie.open(str(path))):
        p, seen = t.query(np.array([3, 3, 9, 9, 2**63 + 1, 4], np.uint64), np.array([2**32 - 1, 2, 0, 1, 7, 1], np.uint32))
        assert seen.tolist() == [True, False, True, False, True, False]
        assert np.allclose(p[seen], [-2, -3, -6], atol=0.02)
