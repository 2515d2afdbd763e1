import hashlib
import itertools
import random
import re
import zlib

import oracle
import pytest

from tsloom.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """(cost, audit, repaired) by trying every edit of every row, with up to one insertion in each gap; rows: (role, text, must go, truncated)."""
    best = None
    gaps = [[""], ["", "u", "a"]]
    for edits in itertools.product("DKUA", repeat=len(rows)):
        if any(b and e != "D" for (_, _, b, _), e in zip(rows, edits)):
            continue
        for ins in itertools.product(gaps[1], repeat=len(rows) + 1):
            cost = 5 * sum(map(len, ins))
            audit, roles, out = "", "", []
            for k, e in enumerate([*edits, None]):
                if ins[k]:
                    audit, roles = audit + "I", roles + ins[k]
                    out.append(({"u": "user", "a": "assistant"}[ins[k]], ""))
                if e is None:
                    continue
                role, text, _, cut = rows[k]
                audit += "R" if e in "UA" else e
                cost += {"D": 2, "K": 0, "U": 1, "A": 1}[e] + (5 if cut and e != "D" else 0)
                if e != "D":
                    role = {"K": role, "U": "user", "A": "assistant"}[e]
                    roles += role[:1] or "?"
                    out.append((role, text))
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def plain(rows):
    """The contract's row of one conversation, from its undamaged rows (turn, role, text), in plain Python."""
    conv, rows = rows
    out = []
    for turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults, fed = set(), [], []
    for _, role, text in out:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        fed.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal), fed


def told(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(40):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        rows = [(r, t, b, c and not b) for r, t, b, c in rows]
        cost, audit, out = brute(rows)
        assert repair.repair(bytearray(repair.kind_of(r[:1], b, c) for r, _, b, c in rows)) == (cost, audit), rows
        assert list(repair._repaired(audit, iter([(r, t) for r, t, _, _ in rows]))) == out


def test_long_conversation_against_whole_paths():
    """Least audits by carrying every state's least path, which takes quadratic space."""
    rng = random.Random(5)
    kinds = bytearray(rng.randrange(len(repair._KINDS)) for _ in range(3000))
    best = {0: (0, "")}
    for k in kinds:
        new = {}
        for s, (c, a) in best.items():
            for to, more, letters in repair._BY_KIND[k][s]:
                new[to] = min(new.get(to, (1 << 60, "")), (c + more, a + letters))
        best = new
    ends = [(c + 5 * t, a + "I" * t) for s, (c, a) in best.items() for t in [{0: 0, 3: 0, 2: 1, 1: 2}[s]]]
    assert repair.repair(kinds) == min(ends)


def test_odd_rows_and_conversations(spark):
    rng = random.Random(2)
    words = ["Hello.", "no end", "", " \t", None, "What?", "A\nb!", "é."]
    convs = {c: [(rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(words)) for _ in range(rng.randint(1, 4))] for c in [None, *range(120)]}
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS Audit", "2 AS _conv", "3 AS gaps").repartition(3)
    got = {r.conv_id: r for r in repair.repaired(df).collect()}
    assert set(got) == set(convs)
    for c, rs in convs.items():
        counts, fed = plain((c, rs))
        assert told(got[c]) == counts, c
        if len(fed) <= 5:
            cost, audit, out = brute(fed)
            assert (got[c].cost, got[c].audit) == (cost, audit)
            assert got[c].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    assert any(r.audit == "" and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got.values())
    assert repair.repaired(df.limit(0)).count() == 0


def test_one_conversation_of_many_rows_and_long_texts(spark):
    df = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('Text ', id, repeat(' word', cast(id % 7 AS int)), '.') AS text")
    df = df.union(spark.createDataFrame([(8, 0, "user", "x" * 3_000_000 + "."), (8, 1, "assistant", "y.")], df.schema))
    got = {r.conv_id: r for r in repair.repaired(df).collect()}
    assert set(got) == {7, 8} and len(got[7].audit) > 18_000
    rows = [(r.turn, r.role, r.text) for r in df.where("conv_id = 7").collect()]
    counts, fed = plain((7, rows))
    assert told(got[7]) == counts
    assert (got[7].cost, got[7].audit) == repair.repair(bytearray(repair.kind_of(r[:1], b, c) for r, _, b, c in fed))


def test_query(spark, sf_dir):
    assert oracle.compare(spark, repair.op12_conversation_repair, repair.SQL, sf_dir) > 0
