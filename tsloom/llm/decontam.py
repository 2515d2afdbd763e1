"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are [0-9a-z and everything beyond ASCII]+ after lower-casing A-Z. The automaton (Blumer et al. 1985, for several
strings) is built on the driver from at most BLOCK_WORDS item words at a time and broadcast; a larger benchmark is
taken in several such blocks, one pass each, and the passes add up. Training words are streamed through it: at each word the
state gives the longest match that ends there. A match of `window` words or more is an occurrence of a window; an item of
fewer words counts where the whole item ends.

Nulls and odd input: null texts have no words, and stay null where texts are cut; null and wordless items have no windows; an item whose id is null marks
words, but is not listed. Repeated items count once by id, repeated documents are judged row by row, empty tables give empty
results or no hits. Other input columns are kept; result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsloom.llm.common import fresh, stored

WINDOW = 10
#: Bound of what one pass broadcasts: words of items (about 300 bytes each in the automaton).
BLOCK_WORDS = 200_000
#: Documents of which a larger part than this is hit are dropped whole; from others the hit spans are cut.
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """States as parallel lists: transitions, suffix link, length; and the items that a window or a short item stands for."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: state that holds a window, to ids; state that holds a short item, to [(length, ids)]
        self.windows: dict[int, set] = {}
        shorts: dict[int, dict[int, set]] = {}
        for i, ws in coded:
            if len(ws) >= window:
                v = n = 0
                for w in ws:
                    v, n = self.step(v, n, w)
                    if n >= window:
                        self.windows.setdefault(self.shrink(v), set()).add(i)
            else:
                v = 0
                for w in ws:
                    v = self.next[v][w]
                shorts.setdefault(v, {}).setdefault(len(ws), set()).add(i)
        self.shorts: dict[int, list] = {}
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):  # a state ends with all that its suffix link ends with
            own = [(n, frozenset(ids)) for n, ids in shorts.get(v, {}).items()]
            if own or self.link[v] in self.shorts:
                self.shorts[v] = own + self.shorts.get(self.link[v], [])

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        new = self._state({}, length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return new

    def _state(self, nxt: dict, length: int) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def step(self, v: int, n: int, w: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        t = self.next[v].get(w)
        while t is None:
            if v == 0:
                return 0, 0
            v = self.link[v]
            n = self.length[v]
            t = self.next[v].get(w)
        return t, n + 1

    def shrink(self, v: int) -> int:
        """The state of the last `window` words of a match."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def scan(self, ws: list[bytes]) -> tuple[list[int], set]:
        """Hit words as [start, end, start, end, ...], and the ids of the items whose windows occur."""
        spans: list[int] = []
        seen, found = set(), set()
        window, shorts, nxt, link, length = self.window, self.shorts, self.next, self.link, self.length
        v = n = 0
        for i, w in enumerate(map(self.vocab.get, ws)):
            if w is None:
                v = n = 0
                continue
            t = nxt[v].get(w)
            while t is None and v:
                v = link[v]
                n = length[v]
                t = nxt[v].get(w)
            if t is None:
                continue
            v, n = t, n + 1
            hit = 0
            if n >= window:
                hit = n
                seen.add(self.shrink(v))
            if v in shorts:
                for m, ids in shorts[v]:
                    if m <= n:
                        hit = max(hit, m)
                        found |= ids
            if hit:
                a = i + 1 - hit
                while spans and a <= spans[-1]:
                    spans.pop()
                    a = min(a, spans.pop())
                spans += [a, i + 1]
        for v in seen:
            found |= self.windows[v]
        return spans, found


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for x, y in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def cut(text: str, spans: list[int]) -> str:
    """text without the words of the spans; a line break stands where a span was."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    out.append(raw[done:])
    return b"\n".join(out).decode()


def _pieces(ws: list[bytes], window: int) -> Iterable[list[bytes]]:
    """An item in pieces of at most BLOCK_WORDS words, which overlap by window - 1: each window is in one of them."""
    size = max(BLOCK_WORDS, window)
    return [ws[a : a + size] for a in range(0, max(1, len(ws) - window + 1), size - window + 1)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterable[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most BLOCK_WORDS words, fetched one partition at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct().toLocalIterator():
        for ws in _pieces(words_of(r.t), window):
            if held and held + len(ws) > BLOCK_WORDS:
                yield block
                block, held = [], 0
            if ws:
                block.append((r.i, ws))
                held += len(ws)
    yield block


_MADE = {"n_words": (T.LongType(), pa.int64()), "hit_spans": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "item_ids": (T.ArrayType(T.StringType()), pa.list_(pa.string()))}


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, id_col: str, item_text_col: str, window: int, max_coverage: float | None) -> DataFrame:
    """docs with the columns of _MADE. With max_coverage, docs alone: cut, and without what is hit in a larger part of its words.

    One pass for each block of items. The last one cuts as well, while it holds the texts; those before it are stored, so that no
    task holds more than one automaton."""
    names = docs.columns
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(k, t) for k, (t, _) in _MADE.items()])
    out, turn = docs, 0
    blocks = iter(_blocks(benchmark, id_col, item_text_col, window))
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        sent = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
        cutting = after is None and max_coverage is not None

        def run(batches, sent=sent, turn=turn, cutting=cutting):
            auto = sent.value
            for b in batches:
                at = b.schema.names.index(text_col)
                before = [b.column(len(names) + k).to_pylist() for k in (1, 2)] if turn else None
                new: list[list] = [[], [], []]
                kept, texts = [], []
                for i, t in enumerate(b.column(at)):
                    t = t.as_py()
                    ws = words_of(t)
                    spans, ids = auto.scan(ws)
                    if before:
                        spans, ids = _merged(before[0][i], spans), ids | set(before[1][i])
                    if cutting:
                        if sum(spans[1::2]) - sum(spans[::2]) <= max_coverage * len(ws):
                            kept.append(i)
                            texts.append(cut(t, spans) if spans else t)
                        continue
                    for c, v in zip(new, (len(ws), spans, sorted(x for x in ids if x is not None)), strict=True):
                        c.append(v)
                columns = [b.column(k) for k in range(len(names))]
                if cutting:
                    columns = [c.take(pa.array(kept, pa.int64())) for c in columns]
                    columns[at] = pa.array(texts, columns[at].type)
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                else:
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(c, t) for c, (_, t) in zip(new, _MADE.values(), strict=True)], names=[*names, *_MADE])

        out = out.mapInArrow(run, docs.schema if cutting else schema)
        if after is not None:
            out = stored(out, "decontam-pass")
        block, turn = after, turn + 1
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, hit_spans (array of word positions: start, end, start, ...) and item_ids (array of strings)."""
    return _passes(docs.drop(*[c for c in docs.columns if c.lower() in _MADE]), benchmark, text_col, id_col, item_text_col, window, None)


def n_hit(spans="hit_spans"):
    """Words in the spans: the sum of ends less the sum of starts."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs, with their own columns alone: hit spans cut from the texts, documents hit in more than max_coverage of their words dropped."""
    clash = [c for c in docs.columns if c.lower() in _MADE]
    apart = dict(zip(clash, fresh(docs, *[f"_{c}" for c in clash]), strict=True))
    found = _passes(docs.withColumnsRenamed(apart), benchmark, apart.get(text_col, text_col), "item_id", "text", window, max_coverage)
    return found.withColumnsRenamed({v: k for k, v in apart.items()})


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


_NORM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_NORM} AS w FROM documents),
b AS (SELECT item_id, {_NORM} AS w FROM benchmark),
wi AS (SELECT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
wu AS (SELECT m, g, list(DISTINCT item_id) AS ids FROM wi GROUP BY m, g),
dm AS (SELECT rn, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM wi)),
h AS (SELECT rn, i, dm.m, ids FROM dm JOIN wu ON wu.m = dm.m AND wu.g = array_to_string(w[i:i + dm.m - 1], ' ')),
c AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + m)) AS p FROM h) GROUP BY rn),
e AS (SELECT rn, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rn, CAST(unnest(ids) AS VARCHAR) AS id FROM h) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rn) LEFT JOIN e USING (rn)
"""
