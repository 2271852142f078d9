"""Reading and writing corpora: files, repositories, sitemaps, packages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.normalize import MAX_BYTES, SUPPORTED, canonical_of, suffix

#: Folders that are never read.
IGNORED_FOLDERS = (".git", ".hg", ".svn", "node_modules", "dist", "build", "__pycache__", "img", "images", "assets")


#: Suffixes of documents whose bytes are no text.
BINARY = ("pdf", "docx", "xlsx", "pptx")


def _taken(path: Column, suffixes: tuple, ignored: tuple) -> Column:
    parts = F.split(path, "/")
    return suffix(path).isin(*suffixes) & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, ignored)))


def scan(files: DataFrame, suffixes: tuple = SUPPORTED, ignored: tuple = IGNORED_FOLDERS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (path, length, ...) that a corpus takes, with status: accepted, or document_too_large. Files in ignored folders at any depth and of other suffixes are left out."""
    kept = files.where(_taken(F.col("path"), suffixes, ignored))
    return kept.withColumn("status", F.when(F.col("length") > max_bytes, "document_too_large").otherwise("accepted"))


def read_corpus(spark: SparkSession, root: str, suffixes: tuple = SUPPORTED, ignored: tuple = IGNORED_FOLDERS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (relative to root), length, status, content, bytes of all files below ``root``: text files have content, in which bytes that are no UTF-8 stand as U+FFFD, the others (pdf and office files) have bytes, for ooxml_text.

    status is accepted or document_too_large; the bytes of the latter are never read, as the limit is a filter of the scan, and both are null. Listing and reading are Spark's; links are not followed by it; a
    file that vanishes after the listing is left out, and so are empty files, which Spark's listing passes over. An empty folder has no rows.
    """
    base = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^.*?\\Q{base}\\E/", "")
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", ignoreMissingFiles="true").load(root)
    taken = files.where(_taken(relative, suffixes, ignored))
    binary = suffix(F.col("path")).isin(*BINARY)
    small = taken.where(F.col("length") <= max_bytes).select(
        relative.alias("path"), "length", F.lit("accepted").alias("status"), F.when(~binary, F.make_valid_utf8(F.col("content").cast("string"))).alias("content"), F.when(binary, F.col("content")).alias("bytes")
    )
    large = taken.where(F.col("length") > max_bytes).select(relative.alias("path"), "length", F.lit("document_too_large").alias("status"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("binary").alias("bytes"))
    return small.unionByName(large)


#: Folders of documentation in order of preference.
DOCS_ROOTS = ("docs/en/docs", "docs/en", "website/docs", "documentation", "docs", "doc", "content/docs")


def select_docs_root(files: DataFrame, language: str | None = None, suffixes: tuple = SUPPORTED, ignored: tuple = IGNORED_FOLDERS) -> DataFrame:
    """repo, docs_root, files: of each repository (repo, path) the first folder of the preference list that holds a document. The list is fixed and stays in one expression, so the files are scanned once and only aggregated."""
    roots = ((f"docs/{language}/docs", f"docs/{language}") if language else ()) + DOCS_ROOTS
    parts = F.split("path", "/")
    docs = files.where(suffix(F.col("path")).isin(*suffixes) & ~F.arrays_overlap(parts, F.array(*map(F.lit, ignored))))
    counts = docs.groupBy("repo").agg(*[F.count_if(F.col("path").startswith(r + "/")).alias(f"n{i}") for i, r in enumerate(roots)])
    root, n = F.lit(None).cast("string"), F.lit(0).cast("long")
    for i, r in reversed(list(enumerate(roots))):
        root, n = F.when(F.col(f"n{i}") > 0, r).otherwise(root), F.when(F.col(f"n{i}") > 0, F.col(f"n{i}")).otherwise(n)
    return counts.select("repo", root.alias("docs_root"), n.alias("files"))


#: Names of license files in order of preference.
LICENSE_FILES = ("LICENSE", "LICENSE.md", "LICENSE.txt", "COPYING")


def detect_license(files: DataFrame) -> DataFrame:
    """repo, status, file, identifier: MIT if the first 1000 characters of the preferred license file say so, else declared; unknown without such a file."""
    rank = F.array_position(F.array(*map(F.lit, LICENSE_FILES)), F.col("path"))
    begin = F.lower(F.substring("content", 1, 1000))
    mit = F.contains(begin, F.lit("mit license")) | F.contains(begin, F.lit("permission is hereby granted"))
    one = files.where(F.col("path").isin(*LICENSE_FILES)).groupBy("repo").agg(F.min_by(F.struct("path", mit.alias("mit")), rank).alias("f"))
    out = files.select("repo").distinct().join(one, "repo", "left")
    return out.select("repo", F.when(F.col("f").isNull(), "unknown").otherwise("declared").alias("status"), F.col("f.path").alias("file"), F.when(F.col("f.mit"), "MIT").when(F.col("f").isNotNull(), "declared").alias("identifier"))


def sitemap_urls(xml: str | None, limit: int = 1000) -> tuple[bool, list[str]]:
    """Whether a sitemap is an index of sitemaps, and its http(s) locations in canonical form, the first of each, at most ``limit``. Malformed XML has none."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return False, []
    found = [(e.text or "").strip() for e in root.iter() if e.tag.rsplit("}", 1)[-1].lower() == "loc"]
    return root.tag.rsplit("}", 1)[-1].lower() == "sitemapindex", list(dict.fromkeys(canonical_of(u) for u in found if u.startswith(("http://", "https://"))))[:limit]


def parse_sitemap(sitemaps: DataFrame, limit: int = 1000) -> DataFrame:
    """sitemap_id, position, url, nested of (sitemap_id, xml): what sitemap_urls finds, one row a location; nested tells indexes from pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for id_, xml in zip(b["sitemap_id"], b["xml"]):
                nested, found = sitemap_urls(xml, limit)
                rows += [(id_, k, u, nested) for k, u in enumerate(found)]
            yield pd.DataFrame(rows, columns=["sitemap_id", "position", "url", "nested"])

    return sitemaps.select("sitemap_id", "xml").mapInPandas(run, "sitemap_id long, position int, url string, nested boolean")


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def package_versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the packages written to ``path`` and committed, the oldest first."""
    fs, Path = _filesystem(spark, path)
    if not fs.exists(Path(f"{path}/commits")):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(Path(f"{path}/commits"))]
    return sorted((int(n), f"{path}/versions/{v}") for n, _, v in (x.partition("-") for x in names) if n.isdigit() and v)


def read_package(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """documents and sources of the package that was committed last; None before the first."""
    versions = package_versions(spark, path)
    if not versions:
        return None
    at = versions[-1][1]
    return spark.read.parquet(f"{at}/documents"), spark.read.json(f"{at}/sources")


def write_package(documents: DataFrame, entries: DataFrame, learned: DataFrame, path: str, keep: int = 2) -> str:
    """Write accepted documents (package_id, destination, content), learned ones unioned in, and their sources (no content, URLs redacted), both partitioned by package; returns the version's folder.

    Both tables go to a folder of a version of its own; only when both are whole one rename makes the version the one that read_package sees. So a write that fails or is killed at any point leaves the
    last package as it was, and readers never see one table without the other. Of two writers at once the later commit wins whole. The last ``keep`` versions stay, for readers that have begun; older ones are
    deleted.
    """
    spark = documents.sparkSession
    fs, Path = _filesystem(spark, path)
    version = uuid.uuid4().hex
    at = f"{path}/versions/{version}"
    accepted = documents.join(entries.where("status = 'accepted'").select("package_id", "destination"), ["package_id", "destination"], "left_semi")
    all_ = accepted.select("package_id", "destination", "content").unionByName(learned.select("package_id", "destination", "content"))
    all_.repartition("package_id", F.pmod(F.xxhash64("destination"), F.lit(16))).write.partitionBy("package_id").parquet(f"{at}/documents")
    sources = entries.withColumns({c: U.redact_url(F.col(c)) for c in ("source", "canonical") if c in entries.columns})
    sources.drop("content").write.partitionBy("package_id").json(f"{at}/sources")
    number = (package_versions(spark, path) or [(0, "")])[-1][0] + 1
    fs.mkdirs(Path(f"{path}/commits"))
    fs.create(Path(f"{path}/_{version}")).close()
    while not fs.rename(Path(f"{path}/_{version}"), Path(f"{path}/commits/{number:012d}-{version}")):
        number += 1
    for n, v in package_versions(spark, path)[:-keep]:
        fs.delete(Path(f"{path}/commits/{n:012d}-{v.rsplit('/', 1)[-1]}"), False)
        fs.delete(Path(v), True)
    return at
