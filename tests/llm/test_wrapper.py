"""Main text by wrapper induction: pages whose text is known, templates without telling names, the matcher against brute force, odd pages."""

import html
import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pytest

from docweave.llm import dom, wrapper

from ..conftest import DATA


def of_article(source):
    """The given pages hold their article in one element of paragraphs and a heading."""
    inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", source, re.S)[1]).replace("<br>", " ")
    return "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)) if x)


def test_given_pages(spark):
    d = f"{DATA}/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = wrapper.op12_wrapper(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == of_article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


def site(n, seed, copies=0):
    """Pages whose elements have no telling names: what is template shows only by comparing them."""
    rng = np.random.default_rng(seed)
    out, want = [], []
    for i in range(n):
        body = [words(rng, 40) for _ in range(rng.integers(2, 6))]
        if i < copies:
            body = ["the same article on several pages of the host " * 4]
        links = "".join(f"<a href='/{j}'>{words(rng, 2)}</a> " for j in range(5))
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        out.append(f"<body><div>Our little site since 1999</div><div>{links}</div><div><h2>Title {i} {words(rng, 3)}</h2>{paragraphs}<p>Write to the editor if you find an error</p></div><div>All rights with the owner of this site</div></body>")
        want.append("\n".join([re.search("<h2>(.*?)</h2>", out[-1])[1], *[b.strip() for b in body]]))
    return out, want


def texts(spark, rows, schema="page_id long, host string, html string"):
    df = spark.createDataFrame(rows, schema)
    return {r["page_id"]: r["text"] for r in wrapper.main_text(df, wrapper.induce(df.select("host", "html"))).collect()}


def test_template_without_names(spark):
    pages, want = site(20, 1, copies=6)
    pages2, want2 = site(12, 2)
    rows = [(i, "a", p) for i, p in enumerate(pages)] + [(100 + i, "b", p) for i, p in enumerate(pages2)]
    got = texts(spark, rows + [(i + 1000, "a", pages[0]) for i in range(40)])  # copies of a page are one page to the statistics
    assert [got[i] for i in range(20)] == want and [got[100 + i] for i in range(12)] == want2 and got[1000] == want[0]


def test_named_elements(spark):
    named = """<!doctype html><html><head><title>No</title></head><body class="home sidebar-left"><header><a href=/>Home</a> Site name</header><div id="cookie-notice">We use cookies <button>OK</button></div>
    <nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="layout"><main><h1>Title &amp; more</h1><p>First&nbsp;paragraph,
    with <b>bold</b> and <a href=x>a link</a>.<br>Second line.<p>Second paragraph<div class="ad-slot">Buy now</div><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table><pre>x  y</pre><script>if (a < b) no()</script>
    <form><input><label>Mail</label> Send</form></main><aside class="sidebar"><p>Related things</p></aside></div><section id="comments"><h3>2 comments</h3><article class="comment"><p>First!</p></article></section><footer>&copy; us</footer>"""
    plain_ = "<body><div class='content'><h2>T</h2><p>Some longer text of the page that counts as content.</p><p>And more.</p></div><div class='comment-list'><p>Reader says a lot of things here, much more than the text.</p></div><div class=footer>x</div>"
    got = texts(spark, [(1, "x", named), (2, "y", plain_)])
    assert got[1] == "Title & more\nFirst paragraph, with bold and a link. Second line.\nSecond paragraph\nOne\nTwo\na\nb\nx y"
    assert got[2] == "T\nSome longer text of the page that counts as content.\nAnd more."


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    wide = "<body>" + "".join(f"<section class='q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'><p>t{i}</p></section>" for i in range(700))
    broken = "<p title='a>b' data-x=it's>One</b></div><p>Two < three &bogus; <!-- open <p>no"
    rows = [(1, "h", None), (2, "h", ""), (3, None, "<p>no host</p>"), (4, "h", deep), (5, "h", long), (6, "h", wide), (7, "h", broken), (7, "h", broken), (None, "h", "plain text"), (8, "h", "<script>only()"), (9, "h", "<")]
    df = spark.createDataFrame([(*r, "mine", 3, "w") for r in rows], "page_id long, host string, html string, Text string, n_chars int, wrapper string")
    out = wrapper.main_text(df, wrapper.induce(df))
    assert out.columns == ["page_id", "text", "n_chars"]
    got = [(r["page_id"], r["text"]) for r in out.collect()]
    assert len(got) == len(rows)
    got = dict(got)
    assert got[1] == got[2] == got[8] == "" and got[3] == "no host" and got[4] == "deep text" and got[5] == "\n".join(["word"] * 30_000) and got[7] == "One\nTwo < three &bogus;" and got[None] == "plain text" and got[9] == "<"
    assert got[6].count("\n") == 699
    none = df.limit(0)
    assert wrapper.main_text(none, wrapper.induce(none)).count() == 0


def brute(a, b):
    """Largest matching of two trees (label, children) that keeps parents and order, by trying all choices."""

    @lru_cache(None)
    def best(x, y):
        if x[0] != y[0]:
            return 0
        most = 0
        for k in range(min(len(x[1]), len(y[1])) + 1):
            for p in combinations(x[1], k):
                for q in combinations(y[1], k):
                    if all(u[0] == v[0] for u, v in zip(p, q)):
                        most = max(most, sum(best(u, v) for u, v in zip(p, q)))
        return most + 1

    return best(a, b)


@pytest.mark.parametrize("seed", range(5))
def test_tree_matching_is_largest(seed):
    rng = np.random.default_rng(seed)

    def grow(depth):
        return (str(rng.choice(list("abc"))) if depth else "body", tuple(grow(depth + 1) for _ in range(rng.integers(0, 4) if depth < 3 else 0)))

    def flat(t):
        label, parent = [], []

        def walk(x, up):
            label.append(x[0])
            parent.append(up)
            own = len(label) - 1
            for c in x[1]:
                walk(c, own)

        walk(t, -1)
        return dom.shape(label, parent)

    for _ in range(20):
        a, b = grow(0), grow(0)
        score, partner = dom.align(flat(a), flat(b))
        assert score == brute(a, b) == sum(p >= 0 for p in partner)
