"""The Arrow helpers as functions for SQL users of a session."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.contracts import faults_of
from ..sources.corpus import sitemap_urls
from .normalize import html_to_markdown, ooxml_parts, pages_of

PAGE = "struct<content:string,canonical:string,title:string,links:array<string>,browser_required:boolean>"
#: Cosine of two arrays as a SQL expression, so it stays in generated code; null if one has no length, or they have different sizes.
COSINE = """CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
CASE WHEN size(a) = size(b) THEN try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END"""


def _office(path: str | None, data: bytes | None) -> list[dict] | None:
    try:
        return [{"number": n, "text": t} for n, t in ooxml_parts(data or b"", str(path).rsplit(".", 1)[-1].lower())]
    except (ValueError, ElementTree.ParseError, zipfile.BadZipFile):
        return None


class PageLinks:
    """page_links(html, url): position, url of a page's links in canonical form; null html has none."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for i, link in enumerate(html_to_markdown(html or "", url or "")["links"]):
            yield i, link


class PageLines:
    """page_lines(html, url): line (from 1), text of a page's Markdown; null html has none."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for i, text in enumerate((html_to_markdown(html or "", url or "")["content"] or "").splitlines(), 1):
            yield i, text


class SitemapLocations:
    """sitemap_locations(xml): position, url, nested: the pages, or the sitemaps (nested), that a sitemap names; malformed XML has none."""

    def eval(self, xml: str) -> Iterator[tuple]:
        nested, found = sitemap_urls(xml, 1_000_000)
        for i, url in enumerate(found):
            yield i, url, nested


class ContractFaultRows:
    """contract_fault_rows(json, schema): code, path: where a JSON text departs from its contract; one that keeps to it has no row."""

    def __init__(self):
        self.parsed = lru_cache(16)(json.loads)

    def eval(self, text: str, schema: str) -> Iterator[tuple]:
        yield from faults_of(text, self.parsed(schema))


class TextChunks:
    """text_chunks(text, size, overlap): chunk (from 0), start, text of overlapping pieces; blank and null texts have none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if text and text.strip(" "):
            for i, start in enumerate(range(0, max(0, len(text) - overlap - 1) + 1, size - overlap)):
                yield i, start, text[start : start + size]


#: Table functions by name, and what they return; each is called once a row, laterally joined to the table that it reads.
TABLE_FUNCTIONS = {
    "page_links": (PageLinks, "position int, url string"),
    "page_lines": (PageLines, "line int, text string"),
    "sitemap_locations": (SitemapLocations, "position int, url string, nested boolean"),
    "contract_fault_rows": (ContractFaultRows, "code string, path string"),
    "text_chunks": (TextChunks, "chunk int, start int, text string"),
}


def register_table_functions(spark: SparkSession) -> None:
    """Registers TABLE_FUNCTIONS for this session's SQL: ``FROM pages p, LATERAL page_links(p.html, p.url)``. Rows go to Python in Arrow batches."""
    for name, (handler, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=kind, useArrow=True))


def register_functions(spark: SparkSession) -> None:
    """Registers for this session's SQL, all but cosine over Arrow batches:

    page_markdown(html, url), office_text(path, bytes) (null for what can't be read), sitemap_urls(xml), contract_faults(json, schema), cosine(a, b), and the table functions.
    """

    @F.pandas_udf(PAGE)
    def page_markdown(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pages_of(html, url)

    @F.pandas_udf("array<struct<number:int,text:string>>")
    def office_text(path: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([_office(p, d) for p, d in zip(path, data)], dtype=object)

    @F.pandas_udf("array<string>")
    def urls(xml: pd.Series) -> pd.Series:
        return pd.Series([sitemap_urls(x, 1_000_000)[1] for x in xml], dtype=object)

    @F.pandas_udf("array<struct<code:string,path:string>>")
    def contract_faults(text: pd.Series, schema: pd.Series) -> pd.Series:
        parsed = lru_cache(16)(json.loads)  # a query has one schema as a rule
        return pd.Series([[{"code": c, "path": p} for c, p in faults_of(t, parsed(s))] for t, s in zip(text, schema)], dtype=object)

    for name, f in {"page_markdown": page_markdown, "office_text": office_text, "sitemap_urls": urls, "contract_faults": contract_faults}.items():
        spark.udf.register(name, f)
    spark.sql(COSINE)
    register_table_functions(spark)
