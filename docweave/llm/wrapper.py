"""Main text of web pages by wrapper induction: what the pages of a host have in common is template, what varies may be content.

1. Every page becomes a tree of places (dom.py) and the digests of the texts in each. Pages that repeat count once.
2. MODELS pages of each host (those with the smallest hash in as many classes) are its models. Every other page of the host is aligned with each of them by simple tree matching;
   sums over all pages say, for every place of a model, how many pages have it, how much text and how much of it in links, and for every text of a place how many have the same one there.
3. A text that CONSTANT of at least PAGES pages have in its place is template. Places whose text is mostly links on the host's pages are template too.
4. A page is read again with its host's wrapper: it is aligned with the model that it fits best. Texts of template go, and those in elements that say themselves that they are
   no article (navigation, forms, adverts, comments). What is left is the article: the article element if the page has one, else the smallest element that holds most of what varies.

Only digests and counts are shuffled by host; sums are built before the shuffle, so a host may have any share of the pages. Pages meet their wrapper by a join whose kind
the optimiser picks by the written wrappers' size.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dom
from .common import each_text, field_list, output_columns, ship, spool, table, unspool

#: Models of a host; the share of pages, and their least number, that make a text template; the share of links that makes a place a menu.
MODELS, CONSTANT, PAGES, LINKS = 4, 0.8, 4, 0.6
#: The share of the varying text that an element needs for the search to go down into it.
MOST = 0.6
#: Counters of a task before they are sent, models and alignments that a worker remembers.
COUNTED_TOGETHER, REMEMBERED = 200_000, 2_000


def host(url: Column) -> Column:
    """The lower-cased host name of a URL, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:/{1,3}(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1), F.lit("")))


def digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _view(source: str) -> str:
    """A page as its host's statistics need it: shape, and by place the code points, those within links and the digests of its texts."""
    page = dom.parse(source)
    of, label, parent = dom.places(page)
    by: dict[int, list] = {}
    for e, text, linked in page.texts:
        x = by.setdefault(of[e], [0, 0, set()])
        x[0] += len(text)
        x[1] += linked
        x[2].add(digest(text))
    return json.dumps([dom.shape(label, parent), [[p, n, linked, sorted(d)] for p, (n, linked, d) in by.items()]], separators=(",", ":"))


class _Aligned:
    """Alignments by the two shapes, the last REMEMBERED of them."""

    def __init__(self):
        self.known: dict[tuple[str, str], tuple[int, list[int]]] = {}

    def __call__(self, a: str, b: str) -> tuple[int, list[int]]:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[a, b] = dom.align(a, b)
        return got


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of pages (host, html): the wrapper holds, for each model, its shape, its template texts by place and the mean lengths of its places.

    Pages without html and pages of a host that has only them take part as empty pages; pages that repeat count once; a host of few pages has a wrapper without template texts.
    """
    spark = pages.sparkSession
    ship(spark)

    def views(batches):
        for b in batches:
            hosts, keys = b.column(0), b.column(1)
            out = []
            at = 0
            for source in each_text(b.column(2)):
                out.append(_view(source or ""))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([hosts.slice(at, len(out)), keys.slice(at, len(out)), pa.array(out)], ["host", "key", "view"])
                    at, out = at + len(out), []
            if out:
                yield pa.RecordBatch.from_arrays([hosts.slice(at), keys.slice(at), pa.array(out)], ["host", "key", "view"])

    once = pages.select("host", F.xxhash64("html").alias("key"), "html").mapInArrow(views, "host string, key long, view string")
    once = spool(once.groupBy("host", "key").agg(F.first("view").alias("view")), "wrapper-views")
    # models: the smallest key of each class of keys
    chosen = once.groupBy("host", F.pmod("key", F.lit(MODELS)).alias("class")).agg(F.min("key").alias("key"))
    models = once.join(chosen, ["host", "key"]).groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(F.struct("class", "view")))).alias("models"))
    models = spool(models, "wrapper-models")

    def count(batches: Iterator[pa.RecordBatch]):
        aligned, known, counts = _Aligned(), {}, {}

        def out():
            items = list(counts.items())
            for i in range(0, len(items), 20_000):
                part = items[i : i + 20_000]
                cols = list(zip(*(k for k, _ in part))), list(zip(*(v for _, v in part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0][0], pa.string()), *[pa.array(c, pa.int64()) for c in (*cols[0][1:], *cols[1])]],
                    ["host", "model", "place", "text", "pages", "chars", "linked"],
                )
            counts.clear()

        for b in batches:
            hosts, found, views_ = b.column(0).to_pylist(), b.column(1), b.column(2)
            for r, name in enumerate(hosts):
                if name not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[name] = [(m["class"], s, {p: d for p, _, _, d in places}) for m in json.loads(found[r].as_py()) for s, places in [json.loads(m["view"])]]
                own, places = json.loads(views_[r].as_py())
                for model, shape, texts in known[name]:
                    partner = aligned(own, shape)[1]
                    there: dict[int, list] = {}
                    for p in range(len(partner)):
                        if partner[p] >= 0:
                            there[partner[p]] = [0, 0, ()]
                    for p, n, linked, digests in places:
                        if partner[p] >= 0:
                            there[partner[p]] = [n, linked, digests]
                    for p, (n, linked, digests) in there.items():
                        x = counts.setdefault((name, model, p, -1), [0, 0, 0])
                        x[0] += 1
                        x[1] += n
                        x[2] += linked
                        if digests and p in texts:
                            for d in texts[p] if len(texts[p]) < len(digests) else digests:
                                if d in texts[p] and d in digests:
                                    counts.setdefault((name, model, p, d), [0, 0, 0])[0] += 1
                if len(counts) >= COUNTED_TOGETHER:
                    yield from out()
        yield from out()

    met = once.join(models, "host").select("host", "models", "view")
    sums = met.mapInArrow(count, "host string, model long, place long, text long, pages long, chars long, linked long")
    sums = sums.groupBy("host", "model", "place", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "linked")])
    # of each model: the places (text = -1), and the texts that most pages with the place have
    places = sums.where("text = -1").select("host", "model", "place", F.col("pages").alias("of"), F.struct("place", "pages", "chars", "linked").alias("p"))
    texts = sums.where((F.col("text") != -1) & (F.col("pages") >= PAGES)).join(places.select("host", "model", "place", "of"), ["host", "model", "place"])
    texts = texts.where(F.col("pages") >= CONSTANT * F.col("of")).groupBy("host", "model").agg(F.collect_list(F.struct("place", "text")).alias("texts"))
    places = places.groupBy("host", "model").agg(F.collect_list("p").alias("places"))
    rules = places.join(texts, ["host", "model"], "left").groupBy("host").agg(F.collect_list(F.struct("model", "places", "texts")).alias("rules"))
    out = models.join(rules, "host").select("host", F.to_json(F.struct("models", "rules")).alias("wrapper"))
    out = spool(out, "wrapper-rules")
    unspool(once, models)
    return out


def read_wrapper(text: str | None) -> list[tuple[str, set, dict]]:
    """Of each model: shape, template texts as (place, digest), and by place (pages, code points, of these in links)."""
    if not text:
        return []
    found = json.loads(text)
    shapes = {m["class"]: json.loads(m["view"])[0] for m in json.loads(found["models"])}
    out = []
    for r in sorted(found["rules"], key=lambda r: r["model"]):
        out.append((shapes[r["model"]], {(t["place"], t["text"]) for t in r.get("texts") or ()}, {p["place"]: (p["pages"], p["chars"], p["linked"]) for p in r["places"]}))
    return out


def article(source: str, wrapper: list, aligned=dom.align) -> list[str]:
    """The blocks of a page's main text, in page order."""
    page = dom.parse(source)
    if not page.texts:
        return []
    n = len(page.tag)
    of, label, parent = dom.places(page)
    constant, stats, partner = set(), {}, [-1] * len(label)
    own = dom.shape(label, parent)
    best = 0
    for shape, texts, sums in wrapper:
        score, pairs = aligned(own, shape)
        if score > best:
            best, partner, constant, stats = score, pairs, texts, sums

    # element sums: code points, and whether an article lies within
    size, holds = [0] * n, [False] * n
    for e, text, _ in page.texts:
        size[e] += len(text)
    for e in range(n - 1, 0, -1):
        size[page.parent[e]] += size[e]
        holds[page.parent[e]] |= holds[e] or page.tag[e] in ("article", "main") or page.tag[e] == "h1"
    whole = size[0]

    # elements that are no article by their own word
    out = [False] * n
    inside = [False] * n  # within an article or main element
    for e in range(1, n):
        up, tag, marks = page.parent[e], page.tag[e], page.marks[e]
        body = tag in ("article", "main") or "main" in marks and tag != "section" or "@articlebody" in marks
        inside[e] = inside[up] or body
        replies = bool(marks & dom.REPLIES)
        chrome = tag in dom.CHROME_TAGS or bool(marks & dom.CHROME) or tag == "header" and not inside[up] and not holds[e]
        if chrome and (body or "hidden" not in marks and tag not in ("nav", "footer") and (holds[e] or not inside[up] and size[e] > MOST * whole and not replies)):
            chrome = False  # a name that the frame of the article has as well
        out[e] = out[up] or chrome or replies
    # texts that may be content, and what they weigh: the mean of their place on the host's pages
    kept, weight = [], [0.0] * n
    for i, (e, text, linked) in enumerate(page.texts):
        if out[e]:
            continue
        p = partner[of[e]]
        pages, chars, links = stats.get(p, (0, 0, 0)) if p >= 0 else (0, 0, 0)
        if p >= 0 and (p, digest(text)) in constant:
            continue
        if not inside[e] and pages >= PAGES and links > LINKS * chars:
            continue  # a menu
        if not inside[e] and linked > 0.9 * len(text) and pages < PAGES:
            continue
        kept.append(i)
        weight[e] += len(text) - linked + (chars - links) / pages if pages >= PAGES else len(text) - linked
    if not kept:
        return []
    for e in range(n - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
    # the article element with most text; without one, down to the element that holds most
    outermost = [e for e in range(1, n) if page.tag[e] == "article" and weight[e] > 0 and not out[e]]
    outermost = [e for e in outermost if not _within(page, page.parent[e], "article")]
    mains = [e for e in range(1, n) if weight[e] > 0 and not out[e] and inside[e] and not inside[page.parent[e]] and page.tag[e] != "article"]
    root = 0
    if mains:
        root = max(mains, key=lambda e: weight[e])
        under = [e for e in outermost if _inside(page, e, root)]
        if under and weight[(top := max(under, key=lambda e: weight[e]))] >= 0.5 * weight[root]:
            root = top
    elif outermost:
        root = max(outermost, key=lambda e: weight[e])
    else:
        below: list[list[int]] = [[] for _ in range(n)]
        for e in range(1, n):
            below[page.parent[e]].append(e)
        while True:
            down = max(below[root], key=lambda e: weight[e], default=None)
            if down is None or page.tag[down] in dom.REPEATED or weight[down] < MOST * weight[root]:
                break
            root = down
    ends = _span(page, root)
    blocks, titled = [], False
    for i in kept:
        e, text, _ = page.texts[i]
        if root <= e < ends:
            blocks.append(text)
            titled |= page.tag[e] == "h1"
        elif page.tag[e] == "h1" and e < root and not titled:
            blocks.append(text)  # the title above the article
            titled = True
    return blocks


def _within(page: dom.Page, e: int, tag: str) -> bool:
    while e > 0:
        if page.tag[e] == tag:
            return True
        e = page.parent[e]
    return False


def _inside(page: dom.Page, e: int, root: int) -> bool:
    while e > root:
        e = page.parent[e]
    return e == root


def _span(page: dom.Page, root: int) -> int:
    """Elements root .. _span - 1 are those of the subtree: they stand in page order."""
    e = root + 1
    while e < len(page.tag) and page.parent[e] >= root:
        e += 1
    return e


def main_text(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """The columns of ``pages`` (host, html, ...) but html and host, with text and n_chars: blocks of the article joined by line feeds, references decoded, white space in a block one space.

    Null and empty html gives an empty text; pages of any length and any markup are read whole; pages that repeat give a row each; a host without wrapper is read by its elements
    alone; columns named text, n_chars or wrapper (in any case) are replaced; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    keep = [c for c in output_columns(pages, ["host", "html", "text", "n_chars", "wrapper"])]
    both = pages.select(*keep, "host", "html").join(wrappers.select(F.col("host").alias("_host"), "wrapper"), F.col("host") == F.col("_host"), "left").select(*keep, "host", "wrapper", "html")

    def read(batches):
        aligned, known = _Aligned(), {}
        for b in batches:
            first = len(keep)
            hosts, found = b.column(first).to_pylist(), b.column(first + 1)
            at, out = 0, []
            for r, source in enumerate(each_text(b.column(first + 2))):
                name = hosts[r]
                if name not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[name] = read_wrapper(found[r].as_py())
                out.append("\n".join(article(source, known[name], aligned)) if source else "")
                if len(out) >= 500 or r + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*[b.column(i).slice(at, len(out)) for i in range(first)], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*keep, "text", "n_chars"])
                    at, out = r + 1, []

    fields = field_list(pages, keep)
    return both.mapInArrow(read, f"{fields}{', ' if fields else ''}text string, n_chars long")


def op12_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", host(F.col("url")).alias("host"), "html")
    return main_text(pages, induce(pages.select("host", "html")))
