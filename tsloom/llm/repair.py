"""Conversation structure repair by Hirschberg's divide and conquer over four states.

A repaired conversation's roles follow (s?(ua)+)?. The states: nothing yet, after the system turn, after a user's, after an
assistant's; a conversation may end in the first and the last. Before each row an empty turn may be inserted, then the row is
kept, given another role or deleted; behind the last row one more turn may be inserted. Two insertions in a row never pay: they
cost 10 and lead to a state that allows no more than the one before.

Hirschberg: cost vectors of the four states run forward over the first half of the rows and backward over the second half; the
sums where they meet give the cheapest crossings. Of several, the one with the least audit counts; each half is solved
alike between its two known states. Audits of one half, one pair of states and one cost never begin one another (each ends with
a row's letter, and has one letter a row), so the least audits of the halves make the least audit of the whole.

In Spark, rows go by conversation twice. The first exchange carries no texts, but a row's role initial, its flags and a hash; a
task streams through its sorted rows and holds some bytes for each row of one conversation. The second exchange carries the
texts behind a header row with the audit, and hashes them as they pass. A conversation is one result row with one hash of all its
text in order, so its rows pass one task in any plan: they are sorted and streamed there, never collected.

Odd input: null ids, roles and texts count as one space (a null id stays null in the result), a null turn as one space in the
draw of the damage and as the first in the order. Rows of one turn are put in order by role and a hash of
the text. Repeated rows are rows of
their own. Conversations of which all rows are dropped have zeros, an empty audit and the hash of nothing; empty tables give
empty results. Other input columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; those in which a conversation may end.
ENDS = (0, 3)
#: The state that a role's initial leads to, from each state that allows it.
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_LED = {0: 2, 1: 2, 2: 3, 3: 2}  # by an inserted or rerolled turn: the user's, or behind it the assistant's
LEGAL = ("su", "ua", "au")
_FAR = 1 << 60


def _row_moves(initial: str, bad: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """From each state: (state after the row, cost, letters), the best insertion before the row included."""
    more = TRUNCATED if truncated else 0
    out: list[list[tuple[int, int, str]]] = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        for state, paid, letters in ((start, 0, ""), (_LED[start], INSERT, "I")):
            ways = [(state, DELETE, "D")]
            if not bad:
                ways.append((_LED[state], REROLE + more, "R"))
                if (initial, state) in _NEXT:
                    ways.append((_NEXT[initial, state], KEEP + more, "K"))
            for to, cost, letter in ways:
                best[to] = min(best.get(to, (_FAR, "")), (paid + cost, letters + letter))
        out.append([(to, c, a) for to, (c, a) in best.items()])
    return out


#: Moves of every kind of row: (initial s, u, a or other; must be deleted; truncated).
_MOVES = {(i, b, t): _row_moves(i, b, t) for i in "sua-" for b in (False, True) for t in (False, True)}
_KINDS = {k: n for n, k in enumerate(_MOVES)}
_BY_KIND = list(_MOVES.values())


def kind_of(initial: str, bad: bool, truncated: bool) -> int:
    return _KINDS[initial if initial in ("s", "u", "a") else "-", bad, truncated and not bad]


def _forward(kinds: bytes | bytearray, lo: int, hi: int, start: int) -> list[int]:
    cost = [_FAR] * 4
    cost[start] = 0
    for k in kinds[lo:hi]:
        new = [_FAR] * 4
        for s, ways in enumerate(_BY_KIND[k]):
            if cost[s] < _FAR:
                for to, c, _ in ways:
                    if cost[s] + c < new[to]:
                        new[to] = cost[s] + c
        cost = new
    return cost


def _backward(kinds: bytes | bytearray, lo: int, hi: int, end: int) -> list[int]:
    cost = [_FAR] * 4
    cost[end] = 0
    for k in reversed(kinds[lo:hi]):
        cost = [min([cost[to] + c for to, c, _ in ways], default=_FAR) for ways in _BY_KIND[k]]
    return cost


def _between(kinds: bytearray, lo: int, hi: int, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """For each (start, end) of states the least audit of rows lo to hi among the cheapest; some way exists for each."""
    if lo == hi:
        return dict.fromkeys(pairs, "")
    if hi - lo == 1:
        return {(s, e): next(a for to, _, a in _BY_KIND[kinds[lo]][s] if to == e) for s, e in pairs}
    mid = (lo + hi) // 2
    ahead = {s: _forward(kinds, lo, mid, s) for s in {s for s, _ in pairs}}
    back = {e: _backward(kinds, mid, hi, e) for e in {e for _, e in pairs}}
    crossings = {}
    for s, e in pairs:
        meet = [f + b for f, b in zip(ahead[s], back[e], strict=True)]
        least = min(meet)
        crossings[s, e] = [x for x, c in enumerate(meet) if c == least]
    left = _between(kinds, lo, mid, {(s, x) for (s, _), xs in crossings.items() for x in xs})
    right = _between(kinds, mid, hi, {(x, e) for (_, e), xs in crossings.items() for x in xs})
    return {(s, e): min(left[s, x] + right[x, e] for x in xs) for (s, e), xs in crossings.items()}


def repair(kinds: bytearray) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows of these kinds; of equal ones the ASCII-least."""
    finals = []
    for s, c in enumerate(_forward(kinds, 0, len(kinds), 0)):
        tail = "" if s in ENDS else "I" * (1 + (s == 1))
        finals.append((c + INSERT * len(tail), s, tail))
    least = min(c for c, _, _ in finals)
    ends = {s: tail for c, s, tail in finals if c == least}
    audits = _between(kinds, 0, len(kinds), {(0, s) for s in ends})
    return least, min(audits[0, s] + tail for s, tail in ends.items())


def damaged(conversations: DataFrame) -> DataFrame:
    """_conv, _turn, _role, _text, _out (1 if the row is dropped): rows damaged by the hash of `conversation:turn`."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select(F.col("conv_id").alias("_conv"), F.col("turn").cast("long").alias("_turn"), spaced("role").alias("_role"), spaced("text").alias("_text"), (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20).alias("_k"))
    k = F.col("_k")
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    role = F.when(k == 4, F.lit("user")).otherwise(F.col("_role"))
    copies = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("_conv", "_turn", role.alias("_role"), text.alias("_text"), (k == 0).cast("int").alias("_out"), F.explode(copies).alias("_copy")).drop("_copy")


def _flags() -> dict[str, Column]:
    """What the audit needs of a row beside its place: initial, whether blank, whether truncated, and a hash of role and text."""
    last = F.right(F.rtrim("_text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return {
        "_initial": F.substring("_role", 1, 1),
        "_blank": (last == "").cast("int"),
        "_cut": (~last.isin(".", "!", "?") & (last != "")).cast("int"),
        "_hash": F.unhex(F.md5(F.concat_ws(":", F.length("_role").cast("string"), "_role", "_text"))),
    }


def _runs(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[tuple[object, list[list]]]:
    """(conversation, columns as lists of values) of consecutive rows of one conversation, cut where a batch ends."""
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        ids = columns[key]
        a = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[a]:
                yield ids[a], [c[a:i] for c in columns]
                a = i


_NONE = object()
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """conversation, the six counts and the audit, from sorted rows (conversation, out, turn, initial, blank, cut, hash)."""

    def ended():
        cost, audit = repair(kinds)
        return (conv, last - first + 1 - turns if turns else 0, blank, duplicate, truncated, illegal, cost, audit)

    conv = _NONE
    for name, (_, out, turn, initial, is_blank, is_cut, digest) in _runs(batches):
        if conv is _NONE or name != conv:
            if conv is not _NONE:
                yield ended()
            conv, kinds, seen = name, bytearray(), set()
            first = last = before = None
            turns = blank = duplicate = truncated = illegal = 0
        for o, t, i, b, c, h in zip(out, turn, initial, is_blank, is_cut, digest, strict=True):
            if o:
                continue
            if t is not None:
                turns += t != last  # sorted: equal turns are neighbours
                first, last = t if first is None else first, t
            illegal += before is not None and before + i not in LEGAL
            before = i
            again = h in seen
            seen.add(h)
            blank += b
            duplicate += again and not b
            truncated += c and not again
            kinds.append(kind_of(i, bool(b or again), bool(c)))
    if conv is not _NONE:
        yield ended()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, as the rows pass."""
    state = 0
    for letter in audit:
        if letter == "I":
            state = _LED[state]
            yield ("user", "assistant")[state == 3], ""
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        state = _NEXT[role[0], state] if letter == "K" else _LED[state]
        yield role if letter == "K" else ("user", "assistant")[state == 3], text


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The result rows, from header rows (no text, but the counts and the audit) each before its conversation's rows in order.

    Rows are read one by one: of a conversation only the audit is held."""

    def stream():
        for name, columns in _runs(batches):
            yield from zip(*columns, strict=True)

    rows = stream()
    head = next(rows, None)
    while head is not None:
        digest, following = hashlib.sha256(), None

        def own():
            nonlocal following
            for r in rows:
                if r[1]:
                    following = r
                    return
                yield r[3], r[4]

        mine, audit, begun = own(), head[-1], False
        for role, text in _repaired(audit, mine):
            digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True
        for _ in mine:  # the audit has a letter for each row: nothing is left, but the next header is found
            pass
        yield (head[0], *head[5:-1], audit, digest.hexdigest())
        head = following


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each damaged conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    place = [F.col("_conv"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_hash")]
    flagged = rows.withColumns(_flags())
    compact = flagged.select("_conv", "_out", "_turn", "_initial", "_blank", "_cut", "_hash", "_role")
    compact = compact.repartition("_conv").sortWithinPartitions(*place).drop("_role")
    counts = ", ".join(f"{c} long" for c in _COUNTS)

    def audits(batches):
        kinds = pa.schema([("_conv", id_type)] + [(c, pa.int64()) for c in _COUNTS] + [("audit", pa.string())])
        return _batched(_audits(batches), kinds)

    def hashes(batches):
        kinds = pa.schema([("conv_id", id_type)] + [(c, pa.int64()) for c in _COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
        return _batched(_hashed(batches), kinds)

    id_type = to_arrow_type(conversations.schema["conv_id"].dataType)
    audited = compact.mapInArrow(audits, f"_conv {kind}, {counts}, audit string")
    heads = audited.select("_conv", F.lit(1).alias("_head"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"), F.lit("").alias("_text"), *_COUNTS, "audit", F.lit(None).cast("binary").alias("_hash"))
    texts = flagged.where("_out = 0").select("_conv", F.lit(0).alias("_head"), "_turn", "_role", "_text", *[F.lit(None).cast("long").alias(c) for c in _COUNTS], F.lit(None).cast("string").alias("audit"), "_hash")
    both = heads.unionByName(texts).repartition("_conv").sortWithinPartitions(F.col("_conv"), F.desc("_head"), *place[1:]).drop("_hash")
    return both.mapInArrow(hashes, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_SPACES = r"[\x20\x09-\x0D]"
SQL = rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT r.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM r, t),
d AS (SELECT conv_id, turn, role, text, md5(length(role) || ':' || role || ':' || text) AS h FROM (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k)),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT conv, turn, role, text, h, left(role, 1) AS i, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, h) AS pos, regexp_extract(text, '([^ 	-
]){_SPACES}*$', 1) AS tail FROM d JOIN c ON d.conv_id IS NOT DISTINCT FROM c.conv_id),
f AS (SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv, h ORDER BY pos) > 1 AS dup, lag(i) OVER (PARTITION BY conv ORDER BY pos) AS prior FROM o),
g AS (SELECT *, NOT blank AND NOT dup AND tail NOT IN ('.', '!', '?') AS cut FROM f),
m(i, a, b, cost, letters) AS (VALUES ('*', 0, 0, 2, 'D'), ('*', 1, 1, 2, 'D'), ('*', 2, 2, 2, 'D'), ('*', 3, 3, 2, 'D'), ('*', 0, 2, 7, 'ID'), ('*', 1, 2, 7, 'ID'), ('*', 2, 3, 7, 'ID'), ('*', 3, 2, 7, 'ID'),
  ('*', 0, 2, 1, 'R'), ('*', 1, 2, 1, 'R'), ('*', 2, 3, 1, 'R'), ('*', 3, 2, 1, 'R'), ('*', 0, 3, 6, 'IR'), ('*', 1, 3, 6, 'IR'), ('*', 2, 2, 6, 'IR'), ('*', 3, 3, 6, 'IR'),
  ('s', 0, 1, 0, 'K'), ('u', 0, 2, 0, 'K'), ('u', 1, 2, 0, 'K'), ('u', 3, 2, 0, 'K'), ('a', 2, 3, 0, 'K'), ('a', 0, 3, 5, 'IK'), ('a', 1, 3, 5, 'IK'), ('a', 3, 3, 5, 'IK'), ('u', 2, 2, 5, 'IK')),
p(conv, pos, state, cost, audit, rows) AS (SELECT conv, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM c UNION ALL
  SELECT p.conv, g.pos, m.b, p.cost + m.cost + CASE WHEN cut AND letters NOT LIKE '%D' THEN 5 ELSE 0 END AS paid, p.audit || letters AS told,
    rows || CASE WHEN letters LIKE 'I%' THEN [CASE WHEN a = 2 THEN 'assistant:' ELSE 'user:' END] ELSE []::VARCHAR[] END || CASE right(letters, 1) WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE WHEN b = 3 THEN 'assistant:' ELSE 'user:' END || text] ELSE []::VARCHAR[] END
  FROM p JOIN g ON g.conv = p.conv AND g.pos = p.pos + 1 JOIN m ON m.a = p.state AND (m.i = '*' OR m.i = g.i) AND (letters LIKE '%D' OR NOT (blank OR dup))
  QUALIFY row_number() OVER (PARTITION BY p.conv, m.b ORDER BY paid, told) = 1),
n AS (SELECT c.conv, coalesce(max(pos), 0) AS n FROM c LEFT JOIN g ON g.conv = c.conv GROUP BY 1),
e AS (SELECT p.conv, p.cost + CASE state WHEN 2 THEN 5 WHEN 1 THEN 10 ELSE 0 END AS cost, audit || CASE state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END AS audit, rows || CASE state WHEN 2 THEN ['assistant:'] WHEN 1 THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END AS rows
  FROM p JOIN n ON n.conv = p.conv AND n.n = p.pos ),
s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(rows, chr(10))) AS repaired_sha256
FROM c JOIN (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost, audit) = 1) USING (conv) LEFT JOIN s USING (conv)
"""
