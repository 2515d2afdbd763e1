"""Main text of web pages: structure by markup, and what a host repeats by its suffix array.

A page is read into blocks (paragraphs, headings, items, cells) once, tag by tag, with the usual repairs of open and misplaced
tags. Scripts, styles, forms' controls and hidden parts hold no text; menus, sidebars, adverts, notices, footers, site headers and
comments are known by their elements, roles or names. Of what is left, an article counts before a main part, and that before an
element named like one; a page without any is taken as a whole.

Host suffix array: the token streams of a host's pages, all of their blocks, cut at block ends, make one generalised suffix array. Only
its order to a depth of DEPTH tokens matters here: a token is covered by a substring of DEPTH or more tokens that distinct pages repeat
just if it lies in a run of DEPTH tokens that they repeat, since every longer one is made of such runs. So suffixes are put together by
host and first DEPTH tokens, which are the array's intervals of neighbours with a common prefix that long, and an interval is repeated if
its smallest page differs from its largest: a partial aggregate, so that an interval of a third of all rows is no burden. Blocks of
fewer tokens are one suffix. Of a block's suffixes those are taken that are the least of WINNOW neighbours by hash (all, if there are
fewer), as in a sparse suffix array: repeats of DEPTH + WINNOW - 1 tokens share one. Pages of the same markup count as one.

What is removed: a template position (the path of elements and classes) of a host most of whose suffixes are repeated; in pages without
an article or the like, blocks of at most LONGEST tokens most of whose suffixes are repeated; and in articles, plain blocks of DEPTH
tokens and more that MANY articles have at the same position, if such texts are most of what the host has there. The last two not in
pages most of which is repeated, which are copies, and these do not count for the last: articles copy and quote each other (a quarter of
the given pages share an article with another one of the host), and their text is wanted whole.

Pages are read three times (four where positions are removed): for the intervals, for the blocks that are in repeated ones, which alone
are stored, and for the text. So neither texts nor suffixes are stored, and a shuffle of suffixes is gone before the next begins.

Odd input: null markup is empty, null addresses belong to one host without a name; empty pages have an empty text; repeated rows are
rows of their own; other columns are kept, but for the markup, and the result's columns replace input columns of their names.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tsloom.llm import tokens
from tsloom.llm.common import Tables, fits, fresh, stored

DEPTH, WINNOW, LONGEST = 8, 8, 50
#: Parts of a position's suffixes that must be repeated: within an article, and elsewhere.
INNER_SHARE, SHARE = 0.8, 0.5
#: Articles that must have a text at the same position before it is part of their template.
MANY = 5
#: Rows of removals (some 50 bytes each) up to which they are broadcast.
MAX_REMOVALS = 200_000
#: Suffixes of an interval that one task meets.
HOT = 2_000

#: Possessive throughout, so that no text makes it look back; a quoted "<" is looked for within 2000 characters.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<]++|"[^"<]*+"|"[^"]{0,2000}+"|'[^'<]*+'|'[^']{0,2000}+')*+|[^><]*+)>|<[!?][^><]*+>""", re.S
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
#: Elements whose content is no text of the page.
SKIPPED = frozenset("head noscript template svg math object audio video canvas select datalist button script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements that a start tag ends, up to the nearest of the bounds.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_BOUND = frozenset("table td th caption html template".split())
_TABLED = frozenset("table td th tr caption tbody thead tfoot".split())

#: Words in classes, ids and roles of parts that are not the article; the second set does not hold inside an article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promoted sidebar sidebars complementary nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager footer contentinfo colophon copyright comment comments disqus respond replies reply cookie cookies consent gdpr notice notices notification notifications alert alertdialog newsletter subscribe subscription signup popup modal overlay lightbox widget widgets share sharing social related recommended recommendations trending teaser teasers skiplink".split()
)
OUTER_HINTS = frozenset("header masthead topbar banner toolbar search login form".split())
_COMMENTS = frozenset("comment comments respond replies reply".split())
_NAMED = frozenset("article articlebody content post entry story".split())
_NOT_PARTS = frozenset("has with without no is".split())
CHROME = frozenset("nav aside footer dialog menu".split())

ARTICLE, MAIN, NAMED = 3, 2, 1


class _Element:
    __slots__ = ("tag", "skip", "chrome", "level", "marked", "path")

    def __init__(self, tag, skip=False, chrome=0, level=0, marked=False, path=0):
        self.tag, self.skip, self.chrome, self.level, self.marked, self.path = tag, skip, chrome, level, marked, path


@functools.lru_cache(100_000)
def _step(path: int, label: str) -> int:
    """A template position as a 64-bit hash of the one above and an element, the same everywhere."""
    return int.from_bytes(hashlib.blake2b(f"{path} {label}".encode(), digest_size=8).digest(), "little", signed=True)


def _element(tag: str, raw: str, up: _Element) -> _Element:
    """The state below a start tag. chrome is 1 where an article may still stand inside, 2 where none counts."""
    e = _Element(tag, up.skip or tag in SKIPPED, up.chrome, up.level, up.marked, up.path)
    names: set[str] = set()
    label = tag
    if raw and not raw.isspace():
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(raw)}
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
            e.skip = True
        named = " ".join(filter(None, (attrs.get("class"), attrs.get("id"), attrs.get("role"))))
        if named:
            names = set(_NAME.findall(_CAMEL.sub(" ", named).lower()))
            label += "." + ".".join(sorted({n if n.isalpha() else "0" for n in names}))
        if attrs.get("itemprop", "").lower() == "articlebody":
            names.add("articlebody")
    if tag in BLOCK:
        e.path = _step(up.path, label)
    if tag in ("html", "body"):
        return e
    comment = bool(names & _COMMENTS) and not names & _NOT_PARTS
    if tag in ("article", "main") or "main" in names and "role" in raw.lower():
        if comment:
            e.chrome = 2
        elif e.chrome < 2:
            e.chrome, e.level, e.marked = 0, max(e.level, ARTICLE if tag == "article" else MAIN), False
        return e
    inside = e.level >= MAIN
    if tag in CHROME or names & HINTS and not names & _NOT_PARTS:
        e.chrome = 2
    elif (tag in ("header", "form") or names & OUTER_HINTS and not names & _NOT_PARTS) and not (inside and tag != "form"):
        e.chrome = max(e.chrome, 2 if inside else 1)
    elif names & _NAMED and e.chrome < 2:
        e.level = max(e.level, NAMED)
    if e.level >= MAIN and tag in BLOCK and names:
        e.marked = True
    return e


def read_blocks(page: str) -> list[tuple[str, int, int, bool, int]]:
    """(text, level, chrome, marked, path) of each block that has text, in page order."""
    stack = [_Element("#")]
    out: list[tuple[str, int, int, bool, int]] = []
    held: list[str] = []
    open_tags: Counter = Counter()

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                e = stack[-1]
                out.append((text, e.level, e.chrome, e.marked, e.path))

    def pop_to(i, ends_block=True):
        if ends_block:
            flush()
        for e in stack[i:]:
            open_tags[e.tag] -= 1
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not stack[-1].skip:
            held.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                held.append(" ")
                continue
            if tag in ("html", "body"):
                continue
            for i in range(len(stack) - 1 if open_tags[tag] else 0, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i, tag in BLOCK or stack[i].chrome != stack[i - 1].chrome)
                    break
                if stack[i].tag in _BOUND and tag not in _TABLED:
                    break
            continue
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not stack[-1].skip:
                held.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            if tag in _ENDS:
                mine, bounds = _ENDS[tag]
                for i in range(len(stack) - 1 if any(open_tags[t] for t in mine) else 0, 0, -1):
                    if stack[i].tag in mine:
                        pop_to(i)
                        break
                    if stack[i].tag in bounds:
                        break
            for i in range(len(stack) - 1 if open_tags["p"] else 0, 0, -1):  # an open paragraph ends where a block begins
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in _BOUND or stack[i].tag in BLOCK:
                    break
        if tag in RAW:
            close = RAW[tag].search(page, at)
            at = close.end() if close else n
            continue
        e = _element(tag, m[3], stack[-1])
        if tag not in BLOCK and e.chrome != stack[-1].chrome:
            flush()
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append(e)
            open_tags[tag] += 1
    flush()
    return out


def _suffixes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; and the distinct taken suffixes of all texts, as the text's number and the suffix's key."""
    step = np.uint64(0xD6E8FEB86659FD93)
    sizes, owners, keys = [], [], []
    for first, _, raw, at in tokens.blocks(pa.array(texts, pa.large_string())):
        h, begins = tokens.words(raw, at)
        size = np.diff(begins)
        run = np.zeros(max(0, len(h) - DEPTH + 1), np.uint64)
        for j in range(DEPTH):
            run = run * step + h[j : j + len(run)]
        run = tokens.mix(run)
        least = np.lib.stride_tricks.sliding_window_view(run, WINNOW).min(axis=1) if (size - DEPTH + 1 > WINNOW).any() else run[:0]
        few = size < DEPTH  # one suffix
        x = size.astype(np.uint64)
        for j in range(DEPTH - 1):
            on = np.flatnonzero(few & (size > j))
            x[on] = x[on] * step + h[begins[on] + j]
        short, every, sparse = np.flatnonzero(few), np.flatnonzero(~few & (size - DEPTH + 1 <= WINNOW)), np.flatnonzero(size - DEPTH + 1 > WINNOW)
        found = [(short, tokens.mix(x[short]))]
        for of, values, counts in ((every, run, size[every] - DEPTH + 1), (sparse, least, size[sparse] - DEPTH - WINNOW + 2)):
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            found.append((np.repeat(of, counts), values[np.repeat(begins[of], counts) + inner]))
        sizes.append(size)
        owners.append(np.concatenate([o for o, _ in found]) + first)
        keys.append(np.concatenate([k for _, k in found]))
    none = np.zeros(0, np.int64)
    owner, key = np.concatenate([none, *owners]), np.concatenate([none.view(np.uint64), *keys])
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    own = np.ones(len(key), bool)
    own[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return np.concatenate([none, *sizes]), owner[own], key[own]


def _joint(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """One key of two."""
    return tokens.mix(tokens.mix(a ^ np.uint64(salt)) + b)


#: What repeats decide on a block by itself: nothing, as part of a template in an article, as a short block of a loose page.
_FIXED, _TEMPLATE, _LOOSE = 0, 1, 2


def _kept(found: list[tuple[str, int, int, bool, int]]) -> tuple[int, list[bool]]:
    """The level that counts in a page, and which of its blocks are of it."""
    top = max((level for _, level, chrome, _, _ in found if not chrome), default=0)
    return top, [not chrome and level == top for _, level, chrome, _, _ in found]


class _Pages:
    """Blocks of a batch of pages, whole: arrays of page, position (host and path), at (number among the page's blocks that its text is
    made of, -1 if it is none) and open (it goes with its position), and of the suffixes' blocks and keys (host and tokens)."""

    def __init__(self, pages: list[str | None], hosts: np.ndarray):
        page, path, at, rule, open_, texts = [], [], [], [], [], []
        for p, html_text in enumerate(pages):
            found = read_blocks(html_text or "")
            top, kept = _kept(found)
            n = 0
            for (text, level, _, marked, sig), k in zip(found, kept, strict=True):
                page.append(p)
                path.append(sig)
                at.append(n if k else -1)
                rule.append(_FIXED if not k else _TEMPLATE if level == ARTICLE and not marked else _LOOSE if top == 0 else _FIXED)
                open_.append(k and (marked or level != ARTICLE))
                texts.append(text)
                n += k
        self.page, self.at, self.open = np.array(page, np.int64), np.array(at, np.int64), np.array(open_, bool)
        hosts = hosts.view(np.uint64)
        self.position = _joint(hosts[self.page], np.array(path, np.int64).view(np.uint64), 1).view(np.int64)
        size, self.owner, key = _suffixes(texts)
        self.key = _joint(hosts[self.page[self.owner]], key).view(np.int64)
        rule = np.array(rule, np.int64)
        self.rule = np.where((rule == _TEMPLATE) & (size < DEPTH) | (rule == _LOOSE) & (size > LONGEST), _FIXED, rule)
        self.n = np.bincount(self.owner, minlength=len(size))
        self.total = np.bincount(self.page[self.at >= 0], weights=self.n[self.at >= 0], minlength=len(pages)).astype(np.int64)


def _in_batches(batches, html_col: str):
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            b = whole.slice(a, 500)
            yield b, b.column(b.schema.names.index(html_col)).to_pylist()


def _longs(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.names.index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def _mapped(df: DataFrame, schema: str | T.StructType, make) -> DataFrame:
    """mapInArrow by make, which gives the columns of each batch as arrays in the order of the schema."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for arrays in make(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type, from_pandas=False) if not isinstance(x, pa.Array) else x for x, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _interval_rows(source: DataFrame, html_col: str, host: str, page: str) -> DataFrame:
    """key, page and 1 for each suffix that a page holds; and for each position, without a page, how many suffixes it has, and whether
    there are blocks that go with it."""

    def make(batches):
        for b, pages in _in_batches(batches, html_col):
            p = _Pages(pages, _longs(b, host))
            of = _longs(b, page)[p.page[p.owner]]
            position, where = np.unique(p.position, return_inverse=True)
            counts = np.bincount(where, weights=p.n, minlength=len(position)).astype(np.int64)
            yield p.key, of, np.ones(len(of), np.int64), np.zeros(len(of), bool)
            yield position, pa.nulls(len(position), pa.int64()), counts, np.bincount(where, weights=p.open, minlength=len(position)) > 0

    return _mapped(source.select(f"`{html_col}`", host, page), "key long, page long, n long, open boolean", make)


def _suffix_rows(source: DataFrame, html_col: str, host: str, row: str) -> DataFrame:
    """Each suffix with its block: row, position, at, rule, n (suffixes of the block) and total (of the page)."""

    def make(batches):
        for b, pages in _in_batches(batches, html_col):
            p = _Pages(pages, _longs(b, host))
            o = p.owner
            yield p.key, _longs(b, row)[p.page[o]], p.position[o], p.at[o], p.rule[o], p.n[o], p.total[p.page[o]]

    return _mapped(source.select(f"`{html_col}`", host, row), "key long, row long, position long, at int, rule int, n int, total int", make)


def _open_rows(source: DataFrame, html_col: str, host: str, row: str) -> DataFrame:
    """Blocks that go with their position: row, at, position and the share of it that must be repeated."""

    def make(batches):
        for b, pages in _in_batches(batches, html_col):
            rows, hosts, out = _longs(b, row), _longs(b, host), []
            for p, page in enumerate(pages):
                found = read_blocks(page or "")
                blocks = [f for f, k in zip(found, _kept(found)[1], strict=True) if k]
                out += [(p, at, path, INNER_SHARE if level >= MAIN else SHARE) for at, (_, level, _, marked, path) in enumerate(blocks) if marked or level != ARTICLE]
            of, at, path, share = zip(*out, strict=True) if out else ((),) * 4
            of = np.array(of, np.int64)
            yield rows[of], np.array(at, np.int32), _joint(hosts[of].view(np.uint64), np.array(path, np.int64).view(np.uint64), 1).view(np.int64), np.array(share, float)

    return _mapped(source.select(f"`{html_col}`", host, row), "row long, at int, position long, share double", make)


def _removed(source: DataFrame, html_col: str, host: str, page: str, row: str) -> DataFrame:
    """row and at of the blocks that are not text of the page."""
    tables = Tables(source.sparkSession)
    counted = _interval_rows(source, html_col, host, page).groupBy("key").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.sum("n").alias("n"), F.max("open").alias("open"))
    counted = tables.store(counted.where("lo IS NULL OR lo <> hi").select("key", "n", "open", F.col("lo").isNull().alias("place")), "pages-intervals")
    positions = counted.where("place").select(F.col("key").alias("position"), F.col("n").alias("whole"), "open")
    # an interval of many suffixes is met in as many parts
    repeated = counted.where("NOT place").select("key", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    hot = F.broadcast(repeated.where("parts > 1"))
    suffixes = _suffix_rows(source, html_col, host, row).join(hot, "key", "left").withColumn("part", F.when(F.col("parts") > 1, F.expr("CAST(pmod(row, parts) AS INT)")).otherwise(0)).drop("parts")
    hits = tables.store(suffixes.join(repeated.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["key", "part"]).drop("part"), "pages-repeats")
    blocks = hits.where("at >= 0").groupBy("row", "position", "at", "rule", "n", "total").agg(F.count_distinct("key").alias("again"))
    copies = tables.store(blocks.groupBy("row").agg((F.sum("again") / F.first("total")).alias("copied")).where(F.col("copied") >= SHARE).select("row"), "pages-copies")
    share = hits.groupBy("position").agg(F.count("*").alias("again")).join(positions.where("open"), "position").select("position", (F.col("again") / F.col("whole")).alias("covered"))
    by_position = _open_rows(source, html_col, host, row).join(_small(share.where(F.col("covered") >= SHARE), tables, "pages-positions"), "position").where("covered >= share").select("row", "at")
    short = blocks.where((F.col("rule") == _LOOSE) & (F.col("again") >= SHARE * F.col("n")))
    by_run = short.join(copies, "row", "left_anti").select("row", "at")
    # what many articles of the host have at the same position, but for the pages that are copies
    taken = blocks.join(copies, "row", "left_semi").groupBy("position").agg(F.sum("n").alias("taken"))
    others = hits.where(F.col("rule") == _TEMPLATE).join(copies, "row", "left_anti")
    common = tables.store(others.groupBy("position", "key").agg(F.count_distinct("row").alias("pages"), F.count("*").alias("again")).where(F.col("pages") >= MANY), "pages-common")
    places = common.groupBy("position").agg(F.sum("again").alias("again")).join(positions, "position").join(taken, "position", "left").where(F.col("again") >= INNER_SHARE * (F.col("whole") - F.coalesce("taken", F.lit(0))))
    texts = _small(common.select("position", "key").join(places.select("position"), "position", "left_semi"), tables, "pages-templates")
    by_template = others.join(texts, ["position", "key"]).groupBy("row", "at", "n").agg(F.count_distinct("key").alias("again")).where(F.col("again") >= SHARE * F.col("n")).select("row", "at")
    removed = stored(by_position.union(by_run).union(by_template).groupBy("row").agg(F.collect_set("at").alias("gone")), "pages-removed")
    tables.drop()
    return removed


def _small(df: DataFrame, tables: Tables, name: str) -> DataFrame:
    df = tables.store(df, name)
    return F.broadcast(df) if fits(df, MAX_REMOVALS) else df


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (its code points)."""
    others = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    row, host, page, gone = fresh(pages, "_row", "_host", "_page", "_gone")
    whole = [F.col(f"`{c}`").cast("string") for c in (url_col, html_col)]
    source = pages.select(
        *[F.col(f"`{c}`") for c in others],
        F.xxhash64(*whole).alias(row),
        F.xxhash64(F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), "://([^/?#]*)", 1), F.lit("")))).alias(host),
        F.xxhash64(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))).alias(page),
        F.col(f"`{html_col}`").alias(html_col),
    )
    removed = _removed(source, html_col, host, page, row).withColumnsRenamed({"row": row, "gone": gone})
    if fits(removed, MAX_REMOVALS):
        removed = F.broadcast(removed)
    out = source.join(removed, row, "left").select(*[F.col(f"`{c}`") for c in others], f"`{html_col}`", gone)
    schema = T.StructType([f for f in out.schema if f.name not in (html_col, gone)] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make(batches):
        for b, markup in _in_batches(batches, html_col):
            texts = []
            for html_text, left_out in zip(markup, b.column(b.schema.names.index(gone)).to_pylist(), strict=True):
                found = read_blocks(html_text or "")
                kept = [f[0] for f, k in zip(found, _kept(found)[1], strict=True) if k]
                left_out = set(left_out or ())
                texts.append(" ".join(t for at, t in enumerate(kept) if at not in left_out))
            yield [*(b.column(i) for i, name in enumerate(b.schema.names) if name not in (html_col, gone)), texts, [len(t) for t in texts]]

    return _mapped(out, schema, make)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
