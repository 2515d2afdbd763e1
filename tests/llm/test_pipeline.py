import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import corpus_pipeline  # noqa: E402
import test_linededup  # noqa: E402
import test_neardup  # noqa: E402
from test_decontam import brute as hits  # noqa: E402

from tsloom.llm import decontam  # noqa: E402
from tsloom.llm.common import stored  # noqa: E402


def test_each_stage_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        seen[name] = (before, {r.doc_id: r.text for r in rows}, rows)
        assert len(rows) == len(seen[name][1])
        if name != "mix":
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in rows)

    before, after, _ = seen["quality"]
    assert 0.6 * len(before) < len(after) < len(before) and all(before[i] == t for i, t in after.items())

    before, after, _ = seen["line_dedup"]
    want = test_linededup.brute_all(sorted(before.items()))
    assert after == {i: t for i, t in want.items() if t == before[i] or any(test_linededup.norm(x) for x in t.split("\n"))}

    before, after, _ = seen["near_duplicates"]
    groups = test_neardup.brute(list(before), list(before.values()), 80)
    assert after == {i: before[i] for i, _, root in groups if i == root}

    before, after, _ = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = hits(list(before.items()), items)
    for i, t in before.items():
        n, hit = found[i][0], found[i][1]
        if not hit:
            assert after[i] == t
        elif hit <= decontam.MAX_COVERAGE * n:
            assert hits([(i, after[i])], items)[i][1] == 0
        else:
            assert i not in after

    before, after, rows = seen["mix"]
    assert rows and all(r.epochs > 0 and before[r.doc_id] == r.text for r in rows)
    total = sum(len(test_neardup.re.findall(r"[^\x20\x09-\x0D]+", t)) for t in before.values())
    assert sum(r.epochs * r.n_tokens for r in rows) <= 0.5 * total + 1


def test_query(spark, sf_dir):
    from tsloom.llm.registry import QUERIES

    assert {"domain", "n_tokens", "epochs"} <= set(QUERIES["pipeline"](spark, "/root/testdata/sf0.001").columns)
