import html
import random
import re

import numpy as np

from tsloom.llm import extract


def flat(page):
    return [(t, lv, ch) for t, lv, ch, _, _ in extract.read_blocks(page)]


def kept(page):
    found = extract.read_blocks(page)
    top = max((lv for _, lv, ch, _, _ in found if not ch), default=0)
    return " ".join(t for t, lv, ch, _, _ in found if not ch and lv == top)


def test_markup():
    assert kept("<article><h1>A&amp;B</h1><p><b>one <i>t</i>wo<br><p>three&nbsp;&lt;x&gt; &amp</article>") == "A&B one two three <x> &"
    assert kept("<article>a<!-- <p>no</p> -->b<script>var t='</p><p>x';</script>c<style>p{}</style></article>") == "abc"
    assert kept("<ARTICLE><P CLASS='x'>Up\n\t per</P><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></ARTICLE>") == "Up per 1 2 a b"
    assert kept("<article><p>1 < 2 and 3 > 2 <3</p><p title='a>b'>q</p></article>") == "1 < 2 and 3 > 2 <3 q"
    assert kept("plain text, no markup &eacute;") == "plain text, no markup é"
    assert kept("") == kept("<article></article>") == kept("<html><head><title>t</title></head></html>") == ""
    assert kept("<p>shown<script>never closed <p>x") == "shown"
    assert kept("<head><title>x</title><meta charset=utf-8><p>body begins") == "body begins"


def test_parts_that_are_not_the_article():
    page = """<!DOCTYPE html><body class="has-sidebar nav-open"><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><form><input><label>Find</label><button>Go</button></form><aside>Side</aside>
    <main><article class="post has-comments"><header><h1>Title</h1></header><p>First.</p><div class="adBox ad">Buy</div><nav>1 2 3</nav>
    <div hidden>h</div><p style="display: none">d</p><form><p>Your mail</p></form><p>Second.</p><footer>Filed under</footer></article>
    <section id="comments"><article><p>I disagree</p></article></section></main><footer>&copy; us</footer></body>"""
    assert kept(page) == "Title First. Second."
    assert kept("<body><form id=all><article><p>In a form</p></article></form>") == "In a form"
    assert kept("<div class='header-wrap'><div>Logo</div><article><p>Text</p></article></div>") == "Text"
    assert kept("<div role=navigation>n</div><div role='main'><p>m</p></div><p>o</p>") == "m"
    assert kept("<div id=menu>n</div><div class=entry-content><p>c</p><div class=comments>r</div></div>") == "c"
    assert kept("<div class=page><div class=menu>n</div><p>loose</p></div>") == "loose"


def words_page(rng, blocks):
    return "<body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body>"


def suffix_array(pages, depth):
    """{(page, block): covered share} by sorting all suffixes of a host and comparing neighbours, page by page."""
    stream = [(tuple(b.lower().split()[k:]), p, i, k) for p, blocks in pages.items() for i, b in enumerate(blocks) for k in range(len(b.split()))]
    stream.sort(key=lambda s: s[0])
    again = set()
    for a in range(len(stream)):
        for c in range(a + 1, len(stream)):
            x, y = stream[a], stream[c]
            same = next((k for k, (u, v) in enumerate(zip(x[0], y[0])) if u != v), min(len(x[0]), len(y[0])))
            whole = x[0] == y[0] and x[3] == y[3] == 0  # short blocks count whole
            if same < depth and not whole:
                if not same:
                    break
                continue
            if x[1] != y[1]:
                again |= {x[1:], y[1:]}
    out = {}
    for p, blocks in pages.items():
        for i, b in enumerate(blocks):
            n = len(b.split())
            starts = {}
            for k in range(max(1, n - depth + 1)):
                starts.setdefault(tuple(b.lower().split()[k : k + depth]), []).append(k)
            out[p, i] = (sum(any((p, i, k) in again for k in ks) for ks in starts.values()), len(starts))
    return out


def test_loose_pages_against_a_suffix_array(spark, monkeypatch):
    monkeypatch.setattr(extract, "DEPTH", 3)
    monkeypatch.setattr(extract, "WINNOW", 10_000)
    rng = random.Random(4)
    some = lambda k: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(k))
    common = [some(9) for _ in range(4)] + ["ok"]
    pages, rows = {}, []
    for p in range(24):
        blocks = [some(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        for c in rng.sample(common, 2):
            blocks.insert(rng.randint(0, len(blocks)), c)
        pages[p] = blocks
        rows.append((p, f"http://h{p % 2}.x/{p}", words_page(rng, blocks)))
    want = {}
    for host in (0, 1):
        mine = {p: b for p, b in pages.items() if p % 2 == host}
        share = suffix_array(mine, 3)
        position = sum(s[0] for s in share.values()) / sum(s[1] for s in share.values())
        assert position < extract.SHARE
        for p, blocks in mine.items():
            copied = sum(share[p, i][0] for i in range(len(blocks))) / sum(share[p, i][1] for i in range(len(blocks)))
            gone = {i for i, b in enumerate(blocks) if share[p, i][0] >= extract.SHARE * share[p, i][1] and len(b.split()) <= extract.LONGEST} if copied < extract.SHARE else set()
            want[p] = " ".join(b for i, b in enumerate(blocks) if i not in gone)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.main_text(df).collect()}
    assert got == want and any(len(t.split()) < sum(len(b.split()) for b in pages[p]) for p, t in want.items())
    monkeypatch.setattr(extract, "MAX_REMOVALS", 0)  # the removals joined by shuffle
    assert {r.page_id: r.text for r in extract.main_text(df).collect()} == want


def test_what_a_host_repeats(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    menu = "Home News Sport Weather Travel Money Culture Contact us"
    page = lambda k: f"<body><div class=x{'' if k else 9}><p>{menu}</p></div><div class=t><p>{text(k)}</p><p>{text(k + 1000)}</p></div></body>"
    inner = lambda k: f"<body><article><p>{text(k)}</p><div class=box>Read all of our stories with an offer for you</div><p>Shared by many articles of the host and wanted whole {menu}</p></article></body>"
    rows = [(k, "http://loose.org/a", page(k)) for k in range(1, 8)] + [(20 + k, "http://In.org/b?q", inner(k)) for k in range(6)] + [(40, "http://alone.org/", page(1))]
    rows += [(50, "http://loose.org/copy", page(1)), (60, None, None), (61, "x", ""), (20, "http://In.org/b?q", inner(0)), (None, None, "<p>null ids</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS Text", "1 AS row", "2 AS host", "3 AS _row", "4 AS gone")
    out = extract.main_text(df)
    assert {"page_id", "url", "row", "host", "_row", "gone", "text", "n_chars"} == set(out.columns)
    rows = out.collect()
    got = {r.page_id: r.text for r in rows}
    for k in range(1, 8):
        assert got[k] == f"{text(k)} {text(k + 1000)}"
    assert got[50] == got[1] and got[40] == f"{menu} {got[1]}"
    for k in range(6):
        assert got[20 + k] == f"{text(k)} Shared by many articles of the host and wanted whole {menu}"
    assert sum(r.page_id == 20 for r in rows) == 2 and got[60] == got[61] == "" and got[None] == "null ids"
    assert all(r.n_chars == len(r.text) and r.gone == 4 for r in rows)
    assert extract.main_text(df.limit(0)).count() == 0


def test_very_long_pages(spark):
    page = "<article>" + "".join(f"<p>word{k} <b>bold{k}" for k in range(100_000)) + "</article>" + "<p" * 50_000 + "<div class='" * 20_000
    df = spark.createDataFrame([(1, "http://a/", page)], "page_id long, url string, html string")
    row = extract.main_text(df).first()
    assert row.text.startswith("word0 bold0 word1") and row.text.endswith("bold99999")


def test_query_against_plain_articles(spark, sf_dir):
    """The given pages hold their article in one element with paragraphs, headings, bold words and breaks."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = extract.op13_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("<(?:br|/?p|/?h1)>", " ", inner))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_all_blocks_are_in_the_array():
    page = "<nav><p>Home</p></nav><article><h1>One two</h1><p>a b c d e f g h i j k l m n o p q r s t u v w x y z</p><p class=t>l</p></article><p>outside</p>"
    p = extract._Pages([page, None, page], np.array([1, 1, 2]))
    assert p.at.tolist() == [-1, 0, 1, 2, -1] * 2 and (p.n > 0).all()
    assert set(p.owner.tolist()) == set(range(10)) and p.total.tolist() == [p.n[1:4].sum(), 0, p.n[1:4].sum()]
    assert not set(p.key[p.owner < 5].tolist()) & set(p.key[p.owner >= 5].tolist())  # by host


def test_what_articles_repeat(spark, monkeypatch):
    """Plain blocks of articles count: as part of a template, and for the loose pages of the host."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    note = "Read all of our stories with an offer made for you"
    said = "This passage stands in an article and in a loose page of the host"
    title = "An article of this name stands here more than once"
    inner = lambda k: f"<article><h1>{title if k < 3 else f'Title {k}'}</h1><p>{text(k)}</p><h2>More</h2><p>{said if k == 3 else text(k + 50)}</p><div>{note}</div></article>"
    rows = [(k, "http://h.org/a", inner(k)) for k in range(8)]
    rows += [(20, "http://copies.org/", inner(3)), (21, "http://copies.org/x", inner(3)), (22, "http://copies.org/y", inner(5)), (30, "http://h.org/l", f"<p>{text(90)}</p><p>{said}</p><p>{text(91)}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"{title if k < 3 else f'Title {k}'} {text(k)} More {said if k == 3 else text(k + 50)}" for k in range(8)}
    want |= {20: f"{want[3]} {note}", 21: f"{want[3]} {note}", 22: f"{want[5]} {note}", 30: f"{text(90)} {text(91)}"}
    assert {r.page_id: r.text for r in extract.main_text(df).collect()} == want
    monkeypatch.setattr(extract, "HOT", 1)  # each repeated interval in parts
    monkeypatch.setattr(extract, "MAX_REMOVALS", 0)
    assert {r.page_id: r.text for r in extract.main_text(df).collect()} == want
