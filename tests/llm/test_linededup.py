import random
import re

from tsloom.llm import common, linededup


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def test_near_lines_ties_and_odd_rows(spark):
    rng = random.Random(2)
    base = [f"word{rng.randint(0, 999)}" for _ in range(60)]
    near = list(base)
    near[30] = "other"
    texts = [(5, "  " + " ".join(base) + "\nunique one\n\n"), (2, "start\n" + " ".join(near).upper()), (3, " ".join(base)), (4, ""), (1, None), (7, "x"), (8, "x\nx\ny"), (9, "a\n" * 300 + "a")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS gone", "2 AS N_LINES", "3 AS node")
    rows = linededup.dedup_lines(df).collect()
    assert {r.doc_id: r.text for r in rows} == brute_all(texts)
    assert {r.doc_id: r.n_lines for r in rows}[9] == 301 and all(r.node == 3 and r.gone == 1 for r in rows)
    twice = spark.createDataFrame([(1, "p\nq"), (1, "p\nq"), (None, "q\nz"), (None, "r\nq")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.text) for r in linededup.dedup_lines(twice).collect())
    assert got[:2] == [(False, "p"), (False, "p")] and len(got) == 4 and sum("q" in t for _, t in got) == 1
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def brute_all(docs, percent=80, k=5):
    """docs: [(id, text)] with distinct ids; what is left of each text, by the shingles at every character and all pairs."""
    lines = {}
    for i, t in docs:
        for p, x in enumerate((t or "").split("\n")):
            if norm(x):
                lines.setdefault(norm(x), []).append((i, p))
    names = list(lines)
    sets = [{n[j : j + k] for j in range(max(1, len(n) - k + 1))} for n in names]
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    stay = {}
    for i, n in enumerate(names):
        stay[find(i)] = min(stay.get(find(i), lines[n][0]), *lines[n])
    kept = set(stay.values())
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not norm(x) or (i, p) in kept) for i, t in docs}


def test_every_character_counts(spark):
    rng = random.Random(8)
    urls = [f"https://www.site{rng.randint(0, 10**9)}.example/{rng.randint(0, 10**9)}" for _ in range(20)]
    signs = [chr(c) for c in range(0x4E00, 0x4E80)] + [chr(0x20000 + c) for c in range(40)]
    head = "".join(rng.choice(signs) for _ in range(12))
    unspaced = [head + "".join(rng.choice(signs) for _ in range(80)) for _ in range(6)]
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 8))) for _ in range(400)]
    pairs = []
    for _ in range(40):
        line = " ".join(rng.choices(words, k=10))
        at = rng.randrange(5, len(line) - 5)
        pairs += [line, line[:at] + "#" + line[at + 1 :]]
    near = unspaced[0][:40] + "x" + unspaced[0][41:]
    docs = list(enumerate([*urls, *unspaced, near, *pairs, "ab", "abc", "abcde", "abcdef"]))
    want = brute_all(docs)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want
    assert all(got[i] == t for i, t in docs[:26]) and got[26] == "" and sum(got[i] == "" for i in range(27, 107)) >= 35


def test_query_against_brute_force_over_every_character(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_all(docs)
    got = {r.doc_id: r.text for r in linededup.op3_line_dedup(spark, sf_dir).collect()}
    assert got == want and any(want[i] != t for i, t in docs)


def test_long_lines_are_listed_by_the_taken_shingles(spark):
    """Near lines of mixed content meet, and what is taken rests on the shingle alone."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü0123456789/-") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    lines = []
    for _ in range(60):
        line = list(" ".join(rng.choices(words, k=120)))
        other = list(line)
        for at in range(30, len(line) - 30, 60):
            other[at] = "\U0001f600"
        lines += ["".join(line), "".join(other)]
    df = spark.createDataFrame(list(enumerate(lines)), "node long, norm string")
    full = {r[0]: set(r[1]) for r in df.select("node", linededup.shingle_set(df.norm)).collect()}
    taken = {r[0]: set(r[1]) for r in df.select("node", linededup.taken_set(df.norm)).collect()}
    shingles = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    kept = lambda x: {s for s in shingles(x) if all(0x20 < ord(c) <= 0xFF for c in s[:2]) and ord(s[0]) & 1 and ord(s[1]) & 2}
    assert all(len(full[i]) == len(shingles(x)) and len(taken[i]) == len(kept(x)) for i, x in enumerate(lines))
    assert all(linededup.DENSE <= len(taken[i]) and 2 * len(taken[i]) < len(full[i]) for i in taken)
    lists = {}
    for r in linededup.signatures(df).collect():
        lists.setdefault(r.node, set()).add(r.list)
    assert all(len(x) <= linededup.TAKEN_BANDS + 1 for x in lists.values())
    assert all(lists[i] & lists[i + 1] for i in range(0, len(lines), 2))


def test_wordy_lines_are_listed_by_their_words(spark):
    """Near lines of many words meet in few lists; words that say little of a line leave it to its shingles."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    lines = []
    for _ in range(60):
        line = rng.choices(words, k=60)
        other = list(line)
        for at in (10, 35):
            other[at] = "another"
        lines += [" ".join(line), " ".join(other)]
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900))
    lines += [" ".join([*rng.sample(words, 25), blob]) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(lines)), "node long, norm string")
    sets = {r[0]: r[1] for r in df.select("node", linededup.word_set(df.norm)).collect()}
    assert all(len(set(sets[i])) == len(sets[i]) == len({w for w in x.split(" ") if len(w) >= linededup.WORD}) for i, x in enumerate(lines))
    lists = {}
    for r in linededup.signatures(df).collect():
        lists.setdefault(r.node, set()).add(r.list)
    assert all(len(lists[i]) <= linededup.WORD_BANDS for i in range(120))
    assert all(lists[i] & lists[i + 1] for i in range(0, 122, 2))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == brute_all(list(enumerate(lines)))


def test_texts_are_stored_once_at_a_time(spark, monkeypatch):
    """What is kept of all lines until the end has no text."""
    kept, gone = {}, []
    store, drop = linededup.Tables.store, linededup.Tables.drop
    monkeypatch.setattr(linededup.Tables, "store", lambda self, df, name, *a: kept.setdefault(id(t := store(self, df, name, *a)), (name, t)) and t)
    monkeypatch.setattr(linededup.Tables, "drop", lambda self, *t: (gone.extend(id(x) for x in t), drop(self, *t))[1])
    linededup.dedup_lines(spark.createDataFrame([(1, "p\nq"), (2, "q\nz")], "doc_id long, text string")).collect()
    left = [t.columns for k, (name, t) in kept.items() if name == "line-places" and k not in gone]
    assert left and not any("norm" in c for c in left)


def test_lists_of_two_lines_are_pairs_without_hubs(spark, monkeypatch):
    """What the hubs' rounds get are longer lists alone; the pairs are few, however many lists they share."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(800)]
    lines = []
    for n in (2, 2, 2, 5):
        line = rng.choices(words, k=40)
        lines += [" ".join([*line[:k], "changed", *line[k + 1 :]]) for k in range(n)]
    seen = {}
    link = linededup.link_lists

    def watched(members, *rest):
        seen["nodes"] = {r.node for r in members.collect()}
        seen["couples"] = {(r.a, r.b) for r in rest[-1].collect()}
        return link(members, *rest)

    monkeypatch.setattr(linededup, "link_lists", watched)
    df = spark.createDataFrame(list(enumerate(lines)), "node long, norm string")
    tables = linededup.Tables(spark)
    roots = {r.node: r.root for r in linededup.line_components(df, tables).collect()}
    tables.drop()
    assert roots == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, **{k: 6 for k in range(6, 11)}}
    assert seen["nodes"] == set(range(6, 11)) and {(0, 1), (2, 3), (4, 5)} <= seen["couples"]


def test_shuffle_files_go_with_the_query_that_stores(spark, monkeypatch):
    key, during = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key)
    write = common._write
    monkeypatch.setattr(common, "_write", lambda *a: (during.append(spark.conf.get(key)), write(*a))[1])
    tables = linededup.Tables(spark)
    assert tables.store(spark.range(9).groupBy("id").count(), "counts").count() == 9
    tables.drop()
    assert during == ["true"] and spark.conf.get(key) == before
