"""Language-model scores from an Elias-Fano n-gram trie (Pibiri and Venturini 2017), sharded over the cluster.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and one end per document. Documents whose crc32(id as text) mod
FOLDS is not HELD_FOLD are counted. The base model is p1(w) = (c + 0.5) / (N + 0.5 (V + 1)). The model is a trigram with
Dirichlet priors (MacKay and Peto 1995), each order the prior of the next:
p2(w | v) = (c(v w) + MU[0] p1(w)) / (c(v) + MU[0]), v the word before or the start;
p3(w | u v) = (c(u v w) + MU[1] p2(w | v)) / (c(u v) + MU[1]), u the word before v or the start. A document's first token has p2.

The work goes in blocks of whole documents and shards of keys, packed in arrays, so that Spark moves few large rows:
1. blocks: documents gathered to about BLOCK_BYTES of text, split into words, stored;
2. each block sends its distinct words with their training counts to shards by hash; a shard adds up, numbers the words that
   occur in training, and returns counts and numbers;
3. each block, joined with these, sends its distinct pairs and triples with their training counts to shards by context; pairs whose context,
   and triples both of whose context's words, hold more than a quarter of an average shard are dealt out by pair or triple;
4. each shard builds its part of the trie: contexts and successors as Elias-Fano sequences, monotone pointers between the
   levels, shares c(v w) / (c(v) + MU[0]) and c(u v w) / (c(u v) + MU[1]) quantised to 8 bits, all in one memory-mapped buffer;
   queries find the context, then its successor within the context's range. Of triples dealt out it holds c(u v w), as the
   context's count is known to none of their shards. What it found goes back, with the counts of pairs;
5. each block adds the shares and what the priors weigh, and sums up by document.
There are as many shards of each kind as hold SHARD_TOKENS tokens on average, so a task's memory does not grow with the corpus. No count is
capped and all texts are used whole. Pairs and triples are told apart by the words' numbers, which are exact: more than 2^32 - 2
distinct training words raise a ValueError. Two of a million words share a 64-bit hash with a probability of 3e-8.

Nulls and odd input: a null text has no words, only the end; a null id counts as "" in the fold. Rows that repeat an id
are documents of their own. With no training documents all counts are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm import tokens
from tsloom.llm.common import stored

FOLDS, HELD_FOLD = 5, 1
BLOCK_BYTES = 10_000_000
SHARD_TOKENS = 2_000_000
#: Weights of the priors of pairs and triples; of those tried, the likeliest on held-out documents at sf0.1.
MU = (2000.0, 10.0)
END = np.uint64(0x5EED0E4D)
#: The number of the start.
START = 2**32 - 1
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


class EliasFano:
    """A monotone sequence of n integers below u: low bits packed, high bits in unary; arrays of 64-bit words in a buffer."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, n: int, bits: int):
        self.low, self.high, self.ranks, self.n, self.bits = low, high, ranks, n, bits

    @staticmethod
    def encode(values: np.ndarray) -> dict:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(((int(at[-1]) >> 6) + 1) * 64 if n else 64, np.uint8)
        ones[at] = 1
        high = np.packbits(ones, bitorder="little").view(np.uint64)
        low = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            pos = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            starts = np.flatnonzero(np.diff(word, prepend=-1))  # words come in order
            low[word[starts]] = np.bitwise_or.reduceat(part << shift, starts)
            over = (shift + np.uint64(bits)) > 64  # at most one value reaches over into each word
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))]).astype(np.uint64)
        return {"low": low, "high": high, "ranks": ranks, "meta": np.array([n, bits], np.uint64)}

    @classmethod
    def view(cls, part: dict) -> EliasFano:
        return cls(part["low"], part["high"], part["ranks"], int(part["meta"][0]), int(part["meta"][1]))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ranks, i.astype(np.uint64), "right") - 1
        left = i - self.ranks[word].astype(np.int64)  # so many ones precede it in its word
        x = self.high[word].copy()
        at = np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            skip = left >= ones
            left -= np.where(skip, ones, 0)
            at += np.where(skip, width, 0)
            x = np.where(skip, x >> np.uint64(width), x)
        out = ((word << 6) + at - i).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            pos = i.astype(np.uint64) * np.uint64(self.bits)
            w, shift = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            part = self.low[w] >> shift
            over = (shift + np.uint64(self.bits)) > 64
            part[over] |= self.low[w[over] + 1] << (np.uint64(64) - shift[over])
            out |= part & np.uint64((1 << self.bits) - 1)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First index in [lo, hi) whose value is x or more (hi: none), and whether it equals x."""
        lo, hi, end = lo.copy(), hi.copy(), hi
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.access(mid) < x[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        found = lo < end
        found[found] = self.access(lo[found]) == x[found]
        return lo, found


class Trie:
    """Two levels: contexts (64 bits), and successors (32 bits) whose values rise through all contexts, context after context."""

    PARTS = ("low", "high", "ranks", "meta")

    def __init__(self, buffer):
        self.buffer = buffer
        sizes = np.frombuffer(buffer, np.uint64, 14)
        at, found = 14 * 8, []
        for n in sizes[:12].tolist():
            found.append(np.frombuffer(buffer, np.uint64, n, at))
            at += 8 * n
        self.contexts, self.pointers, self.successors = (EliasFano.view(dict(zip(self.PARTS, found[4 * i : 4 * i + 4], strict=True))) for i in range(3))
        self.least, self.step = (float(x) for x in np.frombuffer(buffer, np.float64, 2, at))
        self.codes = np.frombuffer(buffer, np.uint8, int(sizes[12]), at + 16)

    @classmethod
    def pack(cls, contexts: np.ndarray, counts: np.ndarray, successors: np.ndarray, log_p: np.ndarray) -> bytes:
        """contexts sorted; counts: successors of each; successors sorted within each context; log_p of each."""
        # monotone through the level: a context's successors are raised by a multiple of 2^32
        level = successors.astype(np.uint64) + (np.repeat(np.arange(len(contexts), dtype=np.uint64), counts) << np.uint64(32))
        seqs = [EliasFano.encode(x) for x in (contexts.astype(np.uint64), np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64), level)]
        arrays = [s[p] for s in seqs for p in cls.PARTS]
        least = float(log_p.min()) if len(log_p) else 0.0
        step = (float(log_p.max()) - least) / 254 or 1.0 if len(log_p) else 1.0
        codes = np.round((log_p - least) / step).astype(np.uint8) + np.uint8(1)
        head = np.array([len(a) for a in arrays] + [len(codes), 0], np.uint64)
        return b"".join([head.tobytes(), *(a.tobytes() for a in arrays), np.array([least, step]).tobytes(), codes.tobytes()])

    @classmethod
    def mapped(cls, packed: bytes) -> Trie:
        buffer = mmap.mmap(-1, max(1, len(packed)))
        buffer.write(packed)
        return cls(buffer)

    @classmethod
    def open(cls, path: str) -> Trie:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of log10 shares, 1 to 255; 0 where the successor is not seen. A context is searched once for a run of its words."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        c, known = self.contexts.successor(np.zeros(len(first), np.int64), np.full(len(first), self.contexts.n, np.int64), context[first].astype(np.uint64))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        live = np.flatnonzero(known)
        lo, hi = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        lo[live], hi[live] = (self.pointers.access(c[live] + i).astype(np.int64) for i in (0, 1))
        at = np.flatnonzero(known[run])
        c, lo, hi = (x[run[at]] for x in (c, lo, hi))
        i, hit = self.successors.successor(lo, hi, word[at].astype(np.uint64) + (c.astype(np.uint64) << _HALF))
        codes = np.zeros(len(context), np.uint8)
        codes[at[hit]] = self.codes[i[hit]]
        return codes

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 shares of seen successors (0 of others), and whether they are seen."""
        codes = self.find(context, word)
        return np.where(codes > 0, self.least + self.step * (codes.astype(float) - 1), 0.0), codes > 0


def _send(*arrays: np.ndarray) -> bytes:
    """The arrays, compressed; numbers of several bytes byte by byte, all their first ones before all second ones."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(planes))


def _got(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * k, 8), 8 + 16 * k, []
    for i in range(k):
        kind, n = np.dtype(chr(head[2 * i])), int(head[2 * i + 1])
        planes = np.frombuffer(raw, np.uint8, kind.itemsize * n, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += kind.itemsize * n
    return out


def _block_tokens(texts: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's documents, the end after each, and each document's offset among them."""
    raw = np.frombuffer(texts, np.uint8)
    found, sizes, i, n = [], [], 0, len(ends) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(ends, ends[i] + tokens.BLOCK_BYTES, "right")) - 1))
        h, at = tokens.words(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        found.append(np.insert(h, at[1:], END))
        sizes.append(np.diff(at) + 1)
        i = j
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], *[np.cumsum(np.concatenate(sizes))]]).astype(np.int64) if sizes else np.zeros(1, np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each element's place among them."""
    order = np.argsort(x)
    inorder = x[order]
    new = np.concatenate([[True], inorder[1:] != inorder[:-1]]) if len(x) else np.zeros(0, bool)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return inorder[new], place


def _held(k) -> bool:
    return zlib.crc32(("" if k is None else str(k)).encode()) % FOLDS == HELD_FOLD


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, n_tokens, ids (array), data: the documents of about BLOCK_BYTES of text each, as offsets, training marks, distinct
    word hashes in order, and each token's place among these."""
    from pyspark import TaskContext

    kind = docs.schema[id_col].dataType

    def run(batches):
        part, turn = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0
        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (t.as_py() or "").encode()
                if ids and held + len(raw) > BLOCK_BYTES:
                    yield out(part, turn, ids, texts, id_type)
                    turn, ids, texts, held = turn + 1, [], [], 0
                ids.append(k)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield out(part, turn, ids, texts, id_type)

    def out(part, turn, ids, texts, id_type):
        h, at = _block_tokens(b"".join(texts), np.cumsum([0, *map(len, texts)]).astype(np.int64))
        keys, place = _distinct(h)
        data = _send(at, np.array([not _held(k) for k in ids], np.uint8), keys, place.astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + turn], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([data], pa.binary())], names=["block", "n_tokens", "ids", "data"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"block long, n_tokens long, ids array<{kind.simpleString()}>, data binary")


_ROW = "shard int, block long, data binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "data"])


_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


def _per_group(made, schema: pa.Schema = _SCHEMA):
    """A generator of batches as the function of tables that applyInArrow takes."""
    return lambda key, t: pa.Table.from_batches(list(made(key, t.to_batches())), schema)


def _per_pair(made, schema: pa.Schema = _SCHEMA):
    return lambda key, a, b: pa.Table.from_batches(list(made(key, a.to_batches(), b.to_batches())), schema)


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h % np.uint64(shards)).astype(np.int64)


def _split(shard: np.ndarray, shards: int):
    """(shard, indices in order) of each shard that occurs."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 65536 else shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1)) if shards <= len(shard) else None
    if cuts is None:
        for s in np.unique(shard).tolist():
            yield s, np.flatnonzero(shard == s)
        return
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def count_words(blocks: DataFrame, shards: int) -> DataFrame:
    """shard, block, data: the training counts and numbers of a block's words in a shard, in order of hash; block -1: the shard's N, V and count of ends."""

    def send(batches):
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                at, train, keys, place = _got(data.as_py())
                counts = np.bincount(place[np.repeat(train.astype(bool), np.diff(at))], minlength=len(keys)).astype(np.uint32)
                yield _rows([(s, block, _send(keys[i], counts[i])) for s, i in _split(_word_shard(keys, shards), shards)])

    def add(key, batches):
        rows = [(block, *_got(data)) for b in batches for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True)]
        keys, place = _distinct(np.concatenate([k for _, k, _ in rows]))
        total = np.bincount(place, weights=np.concatenate([c for *_, c in rows])).astype(np.int64)
        shard, at = key[0].as_py(), 0
        # numbers of different shards never meet; frequent words have small ones, words that training lacks have none
        number = np.empty(len(keys), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(keys)) * shards + shard
        if number[total > 0].max(initial=0) >= START:
            raise ValueError("more than 2^32 - 2 distinct training words")
        number = np.where(total > 0, number, 0).astype(np.uint32)
        out = [(shard, -1, _send(np.array([total.sum(), np.count_nonzero(total), total[keys == END].sum()], np.int64)))]
        for block, k, _ in rows:
            mine = place[at : at + len(k)]
            out.append((shard, block, _send(total[mine], number[mine])))
            at += len(k)
        yield _rows(out)

    return blocks.select("block", "data").mapInArrow(send, _ROW).groupBy("shard").applyInArrow(_per_group(add), _ROW)


class Grams:
    """A block's distinct pairs and triples of words that occur in training, and their shards: pairs below `shards`, triples below twice
    that, triples dealt out one by one below three times that. Made alike for asking and for adding up."""

    def __init__(self, data: bytes, told: dict[int, bytes], shards: int, total: int, starts: int):
        self.at, train, by, place = _got(data)
        count, number = np.zeros(len(by) + 1, np.int64), np.zeros(len(by) + 1, np.uint32)
        for s, i in _split(by, shards):
            count[i], number[i] = _got(told[s])
        count[-1], number[-1] = starts, START
        # the block's words in the order of their numbers, the start as the last
        order = np.argsort(number, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        count, number, word = count[order], number[order], rank[place]
        n, first = len(word), self.at[:-1]
        before = np.concatenate([rank[-1:], word[:-1]])
        before[first] = rank[-1]
        self.c, self.c_before = count[word.astype(np.int64)], count[before.astype(np.int64)]
        self.has_pair = np.flatnonzero((self.c > 0) & (self.c_before > 0))
        pairs, self.pair = _distinct(before[self.has_pair] << _HALF | word[self.has_pair])
        pair_at = np.full(n, -1, np.int64)
        pair_at[self.has_pair] = self.pair
        last = np.concatenate([[-1], pair_at[:-1]])
        last[first] = -1
        self.has_triple = np.flatnonzero((pair_at >= 0) & (last >= 0))
        self.context = last[self.has_triple]
        triples, self.triple = _distinct(self.context.astype(np.uint64) << _HALF | word[self.has_triple])
        self.n_pairs = len(pairs)
        training = np.repeat(train.astype(bool), np.diff(self.at))
        self.seen = np.concatenate([np.bincount(which[training[has]], minlength=m) for which, has, m in ((self.pair, self.has_pair, len(pairs)), (self.triple, self.has_triple, len(triples)))]).astype(np.uint32)
        v, w = (pairs >> _HALF).astype(np.int64), (pairs & _LOW).astype(np.int64)
        of, w3 = (triples >> _HALF).astype(np.int64), (triples & _LOW).astype(np.int64)
        frequent = count.astype(float) * 4 * shards > total
        pair_key = number[v].astype(np.uint64) << _HALF | number[w]
        by_pair = (tokens.mix(np.where(frequent[v], pair_key, number[v].astype(np.uint64))) % np.uint64(shards)).astype(np.int64)
        dealt = frequent[v[of]] & frequent[w[of]]
        key = tokens.mix(pair_key)[of]
        key = np.where(dealt, tokens.mix(key ^ number[w3].astype(np.uint64)), key)
        by_triple = (key % np.uint64(shards)).astype(np.int64) + np.where(dealt, 2 * shards, shards)
        self.shard = np.concatenate([by_pair, by_triple])
        # of each pair and triple: the context's words (of a pair: one), its training count where it is known, the word
        self.a = np.concatenate([number[v], number[v[of]]])
        self.b = np.concatenate([np.zeros(len(v), np.uint32), number[w[of]]])
        self.known = np.concatenate([count[v], np.zeros(len(of), np.int64)])
        self.w = np.concatenate([number[w], number[w3]])


def sharded(blocks: DataFrame, shards: int) -> DataFrame:
    """blocks, with the shard of each distinct word in place of its hash, which takes fewer bytes; all that is asked after the words are numbered."""
    small = np.uint16 if shards <= 65536 else np.uint32

    def run(batches):
        for b in batches:
            data = []
            for x in b.column("data"):
                at, train, keys, place = _got(x.as_py())
                data.append(_send(at, train, _word_shard(keys, shards).astype(small), place))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("ids"), pa.array(data, pa.binary())], names=["block", "ids", "data"])

    return blocks.select("block", "ids", "data").mapInArrow(run, blocks.select("block", "ids", "data").schema)


def _told(rows: list[dict]) -> dict[int, bytes]:
    return {r["shard"]: r["data"] for r in rows}


def ask(blocks: DataFrame, counts: DataFrame, shards: int, total: int, starts: int) -> DataFrame:
    """shard, block, data: the blocks' pairs and triples in each shard."""

    def run(key, left, right):
        told = _told([r for b in right for r in b.to_pylist()])
        for row in [r for b in left for r in b.to_pylist()]:
            g = Grams(row["data"], told, shards, total, starts)
            out = []
            for s, i in _split(g.shard, 3 * shards):
                a, b = g.a[i], g.b[i]
                start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                width = np.diff(np.append(start, len(i))).astype(np.uint32)
                out.append((s, row["block"], _send(np.diff(a[start], prepend=np.uint32(0)), b[start], width, g.known[i][start], g.w[i], g.seen[i])))
            if out:
                yield _rows(out)

    # all columns, as in score(): both read one exchange of the blocks
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_per_pair(run), _ROW)


def answer(asked: DataFrame, shards: int) -> DataFrame:
    """shard (raised by `shards`), block, data: the codes that each shard's part of the trie has for what was asked, what they mean, and the counts of pairs."""

    def run(key, batches):
        shard = key[0].as_py()
        kind = shard // shards
        got = [(block, *_got(data)) for b in batches for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True)]
        # first words come as differences
        contexts, which = _distinct(np.concatenate([np.cumsum(g[1], dtype=np.uint64) << _HALF | g[2] for g in got]))
        width = np.concatenate([g[3] for g in got])
        keys, place = _distinct(np.repeat(which, width).astype(np.uint64) << _HALF | np.concatenate([g[5] for g in got]))
        count = np.bincount(place, weights=np.concatenate([g[6] for g in got]))
        of, word = (keys >> _HALF).astype(np.int64), (keys & _LOW).astype(np.uint32)
        if kind == 0:
            below = np.empty(len(contexts))
            below[which] = np.concatenate([g[4] for g in got])
            below += MU[0]
        else:
            below = np.bincount(of, weights=count) + MU[1] if kind == 1 else np.ones(len(contexts))
        kept = np.flatnonzero(count > 0)
        widths = np.bincount(of[kept], minlength=len(contexts))
        some = np.flatnonzero(widths)
        trie = Trie.mapped(Trie.pack(contexts[some], widths[some], word[kept], np.log10(count[kept] / below[of[kept]])))
        codes = trie.find(contexts[of], word)
        scale, count, at = np.array([trie.least, trie.step]), count.astype(np.int64), 0
        out = []
        for block, *_, w, _ in got:
            mine = place[at : at + len(w)]
            at += len(w)
            out.append((shard + shards, block, _send(scale, codes[mine], *([count[mine]] if kind == 0 else []))))
        yield _rows(out)

    return asked.groupBy("shard").applyInArrow(_per_group(run), _ROW)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType.simpleString()
    blocks = stored(blocks_of(docs, id_col, text_col), "lm-blocks")
    shards = max(2, -(-(blocks.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD_TOKENS))
    counts = stored(count_words(blocks, shards), "lm-counts")
    total = distinct = starts = 0
    for r in counts.where("block = -1").select("data").toLocalIterator():  # three numbers a shard
        n, v, e = _got(bytes(r.data))[0].tolist()
        total, distinct, starts = total + n, distinct + v, starts + e
    counts = counts.where("block >= 0")
    blocks = sharded(blocks, shards)
    answers = answer(ask(blocks, counts, shards, total, starts), shards)
    below = total + 0.5 * (distinct + 1)

    def gather(key, left, right):
        told = _told([r for b in right for r in b.to_pylist()])
        for row in [r for b in left for r in b.to_pylist()]:
            g = Grams(row["data"], told, shards, total, starts)
            share, exact = np.zeros(len(g.seen)), np.zeros(g.n_pairs, np.int64)
            for s, i in _split(g.shard, 3 * shards):
                (least, step), codes, *rest = _got(told[s + shards])
                share[i] = np.where(codes > 0, 10.0 ** (least + step * (codes.astype(float) - 1)), 0.0)
                if rest:
                    exact[i] = rest[0]
            base = (g.c + 0.5) / below
            p = base * MU[0] / (g.c_before + MU[0])
            p[g.has_pair] += share[g.pair]
            above = exact[g.context] + MU[1]  # what a triple's context weighs, with its prior
            extra = share[g.n_pairs :][g.triple]
            extra = np.where(g.shard[g.n_pairs :][g.triple] >= 2 * shards, extra / above, extra)
            p[g.has_triple] = extra + p[g.has_triple] * MU[1] / above
            n, known, base, own = (np.add.reduceat(x, g.at[:-1]) for x in (np.ones(len(p)), (g.c > 0).astype(float), np.log10(base), np.log10(p)))
            cols = [pa.array([_held(k) for k in row["ids"]]), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(own)]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], id_type), *cols], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([("id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    every = counts.union(answers)
    return blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_per_pair(gather, schema), out)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).withColumnRenamed("id", "doc_id")
