"""Normalization: HTML, notebooks, API descriptions and office files to Markdown; locators, outlines, links, transcripts, chunks.

Row-level work without shuffles. Built-in expressions everywhere but for HTML and office files, which need a parser (Arrow helpers).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..functions import urls as U

#: Suffixes of documents, of transcripts that are only reported, and the size limit.
SUPPORTED = ("md", "markdown", "rst", "adoc", "txt", "html", "htm", "pdf", "docx", "py", "c", "h", "cpp", "js", "jsx", "ts", "tsx", "json", "yaml", "yml", "xml", "csv", "ipynb", "xlsx", "pptx")
TRANSCRIPTIONS = ("ass", "srt", "ssa", "vtt")
CODE = ("py", "c", "h", "cpp", "js", "jsx", "ts", "tsx")
MAX_BYTES = 25 * 1024 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.]\.([^.]*)$", 1))


def _text_of(files: DataFrame) -> Column:
    return F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")


def normalize_status(files: DataFrame) -> DataFrame:
    """status and error_code of (path, content, size, is_link): the first rule that holds decides. Other columns stay."""
    s = suffix(F.col("path"))
    empty = _text_of(files) == ""
    rules = [
        (F.coalesce("is_link", F.lit(False)), "error", "symlink_not_allowed"),
        (F.col("content").isNull(), "error", "not_found"),
        (s.isin(*TRANSCRIPTIONS), "ignored", "external_transcription_required"),
        (~s.isin(*SUPPORTED), "ignored", "unsupported_format"),
        (F.col("size") > MAX_BYTES, "error", "document_too_large"),
        ((s == "pdf") & empty, "ocr_required", "ocr_required"),
        (empty, "error", "empty_document"),
    ]
    status, code = F.lit("accepted"), F.lit(None).cast("string")
    for condition, status_, code_ in reversed(rules):
        status, code = F.when(condition, status_).otherwise(status), F.when(condition, code_).otherwise(code)
    return files.withColumns({"format": s, "status": status, "error_code": code})


def with_title(docs: DataFrame) -> DataFrame:
    return docs.withColumn("title", T.markdown_title(F.col("content"), T.file_stem(F.col("path"))))


# --- HTML -----------------------------------------------------------------------------------------------------------


#: Elements that are not shown, elements that stand in paragraphs of their own, and headings.
HIDDEN = frozenset(("script", "style", "noscript", "template", "svg"))
BLOCKS = ("p", "div", "section", "article", "header", "footer", "main", "aside", "blockquote", "tr")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

#: What is written where an element begins and ends. Links are not in the tables, as what they write depends on their target.
BEGINS = {"br": "\n", "li": "\n- ", "pre": "\n\n```\n"} | dict.fromkeys(BLOCKS, "\n\n") | {h: f"\n\n{'#' * n} " for n, h in enumerate(HEADINGS, 1)}
ENDS = dict.fromkeys((*BLOCKS, *HEADINGS, "li"), "\n")
FENCE = "\n```\n"


class _Tokens(HTMLParser):
    """An HTML text as a list of (+1, tag, attributes), (-1, tag, None) and (0, text, None)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, dict | None]] = []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.found.append((1, tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.found.append((-1, tag, None))

    def handle_data(self, data):
        self.found.append((0, data, None))


def _depths(tokens: list, tags) -> list[int]:
    """How many of the elements ``tags`` are open after each token; an end without a beginning counts for nothing."""
    steps = (step if step and name in tags else 0 for step, name, _ in tokens)
    return list(accumulate(steps, lambda depth, step: max(0, depth + step), initial=0))[1:]


def _target(base: str, href: str | None) -> str | None:
    """The canonical URL that a link leads to; None if it leads to no page."""
    try:
        url = urljoin(base, href) if href else ""
        return canonical_of(url) if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def canonical_of(url: str) -> str:
    """functions.urls.canonicalize_url for one string, by the same split into parts."""
    parts = U.PARTS.match(url.strip())
    scheme, netloc, path, query = (x or "" for x in parts.groups())
    scheme = scheme.lower()
    if scheme not in ("http", "https"):
        return url.strip()
    urlsplit(url).port  # noqa: B018  malformed ports raise ValueError, as malformed hosts do
    if "@" not in netloc:
        netloc = re.sub(r":(?:80)?$" if scheme == "http" else r":(?:443)?$", "", netloc.lower())
    return f"{scheme}://{netloc}{path.rstrip('/') or '/'}{'?' + query if query else ''}"


def html_to_markdown(html: str, url: str) -> dict:
    """content (Markdown: headings, paragraphs, list items, code and links of what is shown), canonical, title, links, browser_required of a page."""
    tokens = _Tokens(html).found
    scripts = sum(step == 1 and name == "script" for step, name, _ in tokens)
    # what is hidden goes, then the title is taken out
    tokens = [t for t, depth in zip(tokens, _depths(tokens, HIDDEN)) if not depth]
    in_title = _depths(tokens, ("title",))
    title = [t[1].strip() for t, depth in zip(tokens, in_title) if depth and t[0] == 0]
    tokens = [t for t, depth in zip(tokens, in_title) if (t[1] != "title" if t[0] else not depth)]
    out, links, canonical, link, seen = [], [], None, None, 0
    code_before = 0
    for (step, name, own), code in zip(tokens, _depths(tokens, ("pre",))):
        if step == 0:
            text = name if code else re.sub(r"\s+", " ", name) if name.strip() else ""
            seen += len(text.strip())
            out.append(text)
        elif step == 1:
            out.append(BEGINS.get(name, ""))
            if name == "a" and (to := _target(url, own.get("href"))):
                link = to
                links.append(to)
                out.append("[")
            elif name == "link" and "canonical" in own.get("rel", "").lower().split():
                canonical = _target(url, own.get("href")) or canonical
        elif name == "a" and link:
            out.append(f"]({link})")
            link = None
        else:
            out.append(FENCE if code < code_before else ENDS.get(name, ""))
        code_before = code
    content = re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()
    return {"content": content, "canonical": canonical or canonical_of(url), "title": " ".join(filter(None, title)) or None, "links": list(dict.fromkeys(links)), "browser_required": scripts > 0 and seen < 80}


def pages_of(htmls: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """html_to_markdown for the pages of a batch."""
    rows = []
    for html, url in zip(htmls, urls):
        try:
            rows.append(html_to_markdown(html or "", url or ""))
        except ValueError:
            rows.append(html_to_markdown(html or "", "") | {"canonical": url})
    return pd.DataFrame(rows, columns=["content", "canonical", "title", "links", "browser_required"], index=htmls.index)


def normalize_html(pages: DataFrame) -> DataFrame:
    """page_id, url, content (Markdown), canonical, title, links, browser_required of (page_id, url, html); one Arrow batch at a time, nothing is shuffled. Null html is empty, a page with null or malformed url keeps it as canonical."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["page_id", "url"]], pages_of(b["html"], b["url"])], axis=1)

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, content string, canonical string, title string, links array<string>, browser_required boolean")


# --- notebooks, API descriptions, office files ----------------------------------------------------------------------

NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:string,metadata:struct<language_info:struct<name:string>>>>>"


def notebook_cells(files: DataFrame) -> DataFrame:
    """path, cell (from 1), cell_type, language, source: cells with text, in order. A source may be a string or a list of strings."""
    cells = F.from_json("content", NOTEBOOK)["cells"]
    rows = files.select("path", F.posexplode(cells).alias("i", "c"))
    listed = F.from_json("c.source", "array<string>")
    source = F.when(F.col("c.source").startswith("["), F.array_join(listed, "")).otherwise(F.coalesce("c.source", F.lit("")))
    source = F.regexp_replace(source, r"^\s+|\s+$", "")
    kind = F.lower(F.coalesce("c.cell_type", F.lit("raw")))
    language = F.when(kind == "code", F.coalesce("c.metadata.language_info.name", F.lit("python")))
    return rows.select("path", (F.col("i") + 1).alias("cell"), kind.alias("cell_type"), language.alias("language"), source.alias("source")).where("source <> ''")


def notebook_markdown(files: DataFrame) -> DataFrame:
    """path, content: a title, then each cell under its number, code in fences. Notebooks without cells have their title only."""
    c = notebook_cells(files)
    block = F.concat(F.lit("## Cell "), F.col("cell").cast("string"), F.lit("\n\n"), F.when(F.col("cell_type") == "code", F.concat(F.lit("```"), "language", F.lit("\n\n"), "source", F.lit("\n\n```"))).otherwise(F.col("source")))
    blocks = c.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("cell", block.alias("block")))).alias("blocks"))
    text = F.concat(F.lit("# "), T.file_stem(F.col("path")), F.coalesce(F.concat(F.lit("\n\n"), F.array_join(F.col("blocks.block"), "\n\n")), F.lit("")), F.lit("\n"))
    return files.select("path").join(blocks, "path", "left").select("path", text.alias("content"))


OPERATION = "struct<summary:string,description:string,responses:map<string,struct<description:string>>>"
METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """path, endpoint, method, summary, description, responses (sorted ``code: text``): one row an operation of JSON API descriptions (openapi or swagger, with paths). Other documents have none."""
    doc = F.from_json("content", f"struct<openapi:string,swagger:string,paths:map<string,map<string,{OPERATION}>>>")
    docs = files.select("path", doc.alias("d")).where("(d.openapi IS NOT NULL OR d.swagger IS NOT NULL) AND d.paths IS NOT NULL")
    ops = docs.select("path", F.explode("d.paths").alias("endpoint", "ops")).select("path", "endpoint", F.explode("ops").alias("method", "op"))
    responses = F.array_sort(F.transform(F.map_entries("op.responses"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"]["description"], F.lit("")))))
    return ops.where(F.lower("method").isin(*METHODS)).select("path", "endpoint", F.upper("method").alias("method"), "op.summary", "op.description", F.coalesce(responses, F.array().cast("array<string>")).alias("responses"))


def openapi_markdown(files: DataFrame) -> DataFrame:
    """path, content: title, version, description and servers of a JSON API description, then its operations by endpoint and method, each with its responses. Other documents have no row."""
    info = F.from_json("content", "struct<openapi:string,swagger:string,info:struct<title:string,version:string,description:string>,servers:array<struct<url:string>>>")
    docs = files.select("path", info.alias("d")).where("d.openapi IS NOT NULL OR d.swagger IS NOT NULL")
    line = lambda head, value: F.when(F.trim(value) != "", F.concat(F.lit(head), F.trim(value)))
    servers = F.when(F.size("d.servers") > 0, F.concat(F.lit("## Servers\n\n"), F.array_join(F.transform("d.servers", lambda x: F.concat(F.lit("- "), x["url"])), "\n")))
    head = docs.select("path", F.concat_ws("\n\n", line("# ", F.coalesce("d.info.title", T.file_stem(F.col("path")))), line("Version: ", F.col("d.info.version")), line("", F.col("d.info.description")), servers).alias("head"))
    e = openapi_endpoints(files)
    responses = F.when(F.size("responses") > 0, F.concat(F.lit("Responses:\n\n"), F.array_join(F.transform("responses", lambda x: F.concat(F.lit("- "), x)), "\n")))
    block = F.concat_ws("\n\n", F.concat(F.lit("### "), "method", F.lit(" "), "endpoint"), line("", F.col("summary")), line("", F.col("description")), responses)
    blocks = e.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("endpoint", "method", block.alias("block")))).alias("blocks"))  # as many as the file describes
    return head.join(blocks, "path", "left").select("path", F.concat(F.concat_ws("\n\n", "head", F.when(F.size("blocks") > 0, F.concat(F.lit("## Endpoints\n\n"), F.array_join("blocks.block", "\n\n")))), F.lit("\n")).alias("content"))


#: The parts of an office file that hold text, and what stands for one line of it: a row's cells, or a run of text.
PARTS = {"xlsx": (re.compile(r"xl/worksheets/sheet(\d+)\.xml"), "row"), "pptx": (re.compile(r"ppt/slides/slide(\d+)\.xml"), "t")}
#: What a cell of each type says, from the texts of its value, inline string and formula; other types say their value.
CELLS = {"s": lambda c, shared: shared.get(c.get("v", ""), c.get("v", "")), "inlineStr": lambda c, shared: c.get("is", "")}


def _elements(z: zipfile.ZipFile, name: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """(name without namespace, element) of an XML part, as elements end."""
    with z.open(name) as part:
        for _, e in ElementTree.iterparse(part):
            yield e.tag.rpartition("}")[2], e


def _said(e: ElementTree.Element) -> str:
    return "".join(e.itertext()).strip()


def _cell(e: ElementTree.Element, shared: dict[str, str]) -> str:
    own: dict[str, str] = {}
    for child in e:
        own.setdefault(child.tag.rpartition("}")[2], _said(child))
    said = CELLS.get(e.get("t"), lambda c, shared: c.get("v", ""))(own, shared) or ("=" + own["f"] if "f" in own else "")
    place = e.get("r", "").strip()
    return f"{place}={said}" if place else said


def _lines(z: zipfile.ZipFile, name: str, line: str, shared: dict[str, str]) -> Iterator[str]:
    for tag, e in _elements(z, name):
        if tag == line:
            yield "\t".join(_cell(c, shared) for c in e if c.tag.rpartition("}")[2] == "c") if line == "row" else _said(e)
            e.clear()  # a part's lines are not kept


def ooxml_parts(data: bytes, kind: str, limit: int = 100 * 1024 * 1024) -> list[tuple[int, str]]:
    """(number, text) of the sheets of an .xlsx or the slides of a .pptx, in order; parts without text are left out but keep their number.
    Raises ValueError for what is no such archive or expands beyond ``limit``."""
    if not zipfile.is_zipfile(io.BytesIO(data)):
        raise ValueError("not an archive")
    form, line = PARTS.get(kind, PARTS["pptx"])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > limit:
            raise ValueError("archive too large")
        parts = sorted((int(m[1]), m[0]) for m in map(form.fullmatch, z.namelist()) if m)
        if not parts:
            raise ValueError("no sheets or slides")
        strings = (_said(e) for tag, e in _elements(z, "xl/sharedStrings.xml") if tag == "si") if line == "row" and "xl/sharedStrings.xml" in z.namelist() else ()
        shared = {str(i): text for i, text in enumerate(strings)}
        texts = ["\n".join(filter(None, _lines(z, name, line, shared))) for _, name in parts]
    return [(k, text) for k, text in enumerate(texts, 1) if text]


def ooxml_text(files: DataFrame) -> DataFrame:
    """path, number, text of (path, bytes): one row a sheet or slide; what can't be read has one row with number 0 and the reason in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["bytes"]):
                try:
                    rows += [(path, n, t, None) for n, t in ooxml_parts(data or b"", str(path).rsplit(".", 1)[-1].lower())]
                except (ValueError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    rows.append((path, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "number", "text", "error"])

    return files.select("path", "bytes").mapInPandas(run, "path string, number int, text string, error string")


# --- locators, outlines, links --------------------------------------------------------------------------------------

#: Headings, time marks and code definitions.
HEADING = r"^\s*(#{1,6})\s+(.+?)\s*#*\s*$"
ANY_HEADING = r"^\s*#{1,6}\s+\S"
TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
TIME_RANGE = rf"^\s*({TIME})\s*-->\s*({TIME})(?:\s+.*)?$"
TIME_BRACKET = rf"\[({TIME})(?:\s*[-–—]\s*({TIME}))?\]"
DEFINITION = r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)|^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)|^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*="
SPECIAL = r"(?i)^(Page|Slide|Sheet|Cell)\s+(\d+)$"


def extract_locators(docs: DataFrame) -> DataFrame:
    """One row a locator of (path, content, format): kind, label, level, number, start, end, line_start, line_end, available.

    Sections (headings from level two on; page, slide, sheet and cell headings by number) end before the next heading of any level. Then time marks of a line, then code definitions in
    code formats. A document without any has one ``normalized_section``. All are found in arrays of the document's own row: one pass, no shuffle, and only found locators become rows.
    """
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def locator(kind, label, first, last, level=none_i, number=none_i, start=none_s, end=none_s, available=True):
        values = {"kind": kind, "label": label, "level": level, "number": number, "start": start, "end": end, "line_start": first, "line_end": last, "available": F.lit(available)}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    numbered = F.transform(T.lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    d = docs.select("path", "format", numbered.alias("lines"))
    d = d.select("path", "format", "lines", F.filter("lines", lambda x: x["line"].rlike(ANY_HEADING)).alias("heads"))

    def section(x, i):
        label, level = F.trim(F.regexp_extract(x["line"], HEADING, 2)), F.length(F.regexp_extract(x["line"], HEADING, 1))
        last = F.coalesce(F.get("heads", i + 1)["n"] - 1, F.size("lines"))
        special = label.rlike(SPECIAL)
        kind = F.when(special, F.lower(F.regexp_extract(label, SPECIAL, 1))).otherwise("section")
        return F.when((level >= 2) & (label != ""), locator(kind, label, x["n"], last, F.when(~special, level), F.when(special, F.regexp_extract(label, SPECIAL, 2).cast("int"))))

    def stamp(x):
        ranged = x["line"].rlike(TIME_RANGE)
        part = lambda k: F.when(ranged, F.regexp_extract(x["line"], TIME_RANGE, k)).otherwise(F.regexp_extract(x["line"], TIME_BRACKET, k))
        start, end = part(1), F.nullif(part(2), F.lit(""))
        return locator(F.lit("timestamp"), F.concat_ws(" - ", start, end), x["n"], x["n"], start=start, end=end)

    def definition(x):
        return locator(F.lit("identifier"), F.concat(*[F.regexp_extract(x["line"], DEFINITION, i) for i in (1, 2, 3)]), x["n"], x["n"])

    stamps = F.transform(F.filter("lines", lambda x: x["line"].rlike(TIME_RANGE) | x["line"].rlike(TIME_BRACKET)), stamp)
    coded = F.when(F.col("format").isin(*CODE), F.col("lines")).otherwise(F.slice("lines", 1, 0))
    definitions = F.transform(F.filter(coded, lambda x: x["line"].rlike(DEFINITION)), definition)
    found = F.concat(F.array_compact(F.transform("heads", section)), stamps, definitions)
    whole = F.array(locator(F.lit("normalized_section"), F.lit("normalized-content"), F.lit(1), F.greatest(F.size("lines"), F.lit(1)), available=False))
    d = d.select("path", found.alias("found"), whole.alias("whole"))
    return d.select("path", F.inline(F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("whole"))))


def outline(docs: DataFrame, max_headings: int = 40) -> DataFrame:
    """path, position (from 1), heading: the first headings of each document, marks stripped."""
    heads = F.filter(T.lines(F.col("content")), lambda x: x.rlike(r"^\s*#"))
    heads = F.slice(F.transform(heads, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*#+\s*", ""), r"\s+$", "")), 1, max_headings)
    return docs.select("path", F.posexplode(heads).alias("i", "heading")).select("path", (F.col("i") + 1).alias("position"), "heading")


def chapter_index(docs: DataFrame, package: str = "source_id") -> DataFrame:
    """Chapter numbers and file names of each package's documents (package, path, title), ordered by path. A name that is taken gets its number appended."""
    order = Window.partitionBy(package).orderBy("path")
    slug = F.regexp_replace(F.regexp_replace(T.casefold_safe(F.col("title")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    c = docs.withColumn("chapter", F.row_number().over(order))
    name = F.concat(F.lpad(F.col("chapter").cast("string"), F.greatest(F.lit(2), F.length(F.col("chapter").cast("string"))), F.lit("0")), F.lit("-"), F.when(slug == "", "source").otherwise(slug))
    c = c.withColumn("stem", name)
    nth = F.row_number().over(Window.partitionBy(package, "stem").orderBy("chapter"))
    return c.withColumn("name", F.concat("stem", F.when(nth > 1, F.concat(F.lit("--"), F.col("chapter").cast("string"))).otherwise(""), F.lit(".md"))).select(package, "path", "chapter", "name")


LINK = r"\[[^\]]*\]\(([^)]+)\)"


def extract_links(docs: DataFrame) -> DataFrame:
    """path, position (from 0), target, target_path, fragment of the Markdown links of (path, content); angle brackets around a target go."""
    found = docs.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(LINK), F.lit(1))).alias("position", "raw"))
    t = F.regexp_replace(F.trim("raw"), "^<(.*)>$", "$1")
    return found.select("path", "position", t.alias("target"), F.regexp_extract(t, "^([^#]*)", 1).alias("target_path"), F.regexp_extract(t, "^[^#]*#(.*)$", 1).alias("fragment"))


# --- transcripts, chunks, metrics -----------------------------------------------------------------------------------

TRANSCRIPT_LINE = rf"(?i)^\s*(?:[-*>]\s*)?(?:\[\s*)?({TIME})\s*(?:\]|\s)*(?:-->|-|–|—|to)\s*(?:\[\s*)?({TIME})(?:\s*\])?\s*(.*)$"


def transcript_segments(transcripts: DataFrame, max_bytes: int = 2_000_000, max_segments: int = 10_000) -> DataFrame:
    """transcript_id, segment, start_ms, end_ms, text, error of (transcript_id, text): one row a line that is neither blank nor a heading.

    error names what is wrong with a line (no interval, interval that ends before it starts, start before that of the line above) or the whole (too many bytes or segments).
    """
    rows = F.filter(F.transform(T.lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("t"))), lambda x: (F.trim(x["t"]) != "") & ~x["t"].rlike(r"^\s*#"))
    t = transcripts.select("transcript_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), rows.alias("rows"))
    t = t.select("transcript_id", "bytes", F.size("rows").alias("n"), F.posexplode("rows").alias("i", "r"))
    line = F.col("r.t")
    t = t.withColumns({"start_ms": R.timestamp_ms(F.regexp_extract(line, TRANSCRIPT_LINE, 1)), "end_ms": R.timestamp_ms(F.regexp_extract(line, TRANSCRIPT_LINE, 2)), "said": F.regexp_extract(line, TRANSCRIPT_LINE, 3)})
    before = F.lag("start_ms").over(Window.partitionBy("transcript_id").orderBy("i"))
    error = (
        F.when(F.col("bytes") > max_bytes, "too_many_bytes").when(F.col("n") > max_segments, "too_many_segments")
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "interval_missing").when(F.col("end_ms") <= F.col("start_ms"), "interval_reversed")
        .when(F.col("start_ms") < before, "not_chronological")
    )
    return t.select("transcript_id", (F.col("i") + 1).alias("segment"), "start_ms", "end_ms", F.col("said").alias("text"), error.alias("error"))


def chunk_text(docs: DataFrame, size: int = 1000, overlap: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, the columns ``keep``, chunk (from 0), start (from 0), text: windows of ``size`` characters, each ``overlap`` into the last. Blank and null texts have none; the last window reaches the end."""
    n = F.length("content")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(size - overlap))
    found = docs.where("content IS NOT NULL AND trim(content) <> ''").select("path", *keep, "content", F.posexplode(starts).alias("chunk", "start"))
    return found.select("path", *keep, "chunk", "start", F.substring("content", F.col("start") + 1, F.lit(size)).alias("text"))


def corpus_metrics(docs: DataFrame, package: str = "source_id", per_chunk: int = 950) -> DataFrame:
    """documents, characters and the estimated number of chunks of each package."""
    chunks = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("content", F.lit(""))) / per_chunk))
    return docs.groupBy(package).agg(F.count(F.lit(1)).alias("corpus_documents"), F.sum(F.length("content")).alias("characters"), F.sum(chunks).cast("long").alias("operator_chunks"))


def page_entries(pages: DataFrame) -> DataFrame:
    """One entry a normalized page (seq, url, content, canonical, browser_required): status, reason, content_hash, destination.

    Pages that need a browser and empty pages are errors; of pages with equal canonical URL the first in order of seq is accepted, the rest are ignored.
    """
    bad = F.when(F.col("browser_required"), "browser_rendering_required").when(F.trim("content") == "", "empty_document")
    p = pages.withColumn("bad", bad)
    nth = F.row_number().over(Window.partitionBy("canonical", F.col("bad").isNull()).orderBy("seq"))
    p = p.withColumn("reason", F.coalesce("bad", F.when(nth > 1, "duplicate-canonical")))
    status = F.when(F.col("bad").isNotNull(), "error").when(F.col("reason").isNotNull(), "ignored").otherwise("accepted")
    ok = F.col("reason").isNull()
    return p.select("seq", F.col("url").alias("source"), "canonical", status.alias("status"), "reason", F.when(ok, F.sha2("content", 256)).alias("content_hash"), F.when(ok, U.destination_for_url(F.col("canonical"))).alias("destination"))
