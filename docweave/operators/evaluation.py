"""Evaluation of retrieval and answers against reviewed questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Gates.
GATES = {"recall": 0.85, "mrr": 0.7, "response_fidelity": 0.98, "citation_coverage": 0.98}


def expected_path(path: Column) -> Column:
    """The path inside the corpus: one of three prefixes is dropped, else leading dots and slashes."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    return F.when(p.rlike("^(documents/|rag/documents/|skill/)"), F.regexp_replace(p, "^(documents/|rag/documents/|skill/)", "")).otherwise(F.regexp_replace(p, "^[./]+", ""))


def case_ranks(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, kind, rank of the expected path among the hits (query_id = case_id, path, rank); null if it is not there. Router cases are left out."""
    g = golden.where(F.coalesce("kind", F.lit("factual")) != "router").select("case_id", F.coalesce("kind", F.lit("factual")).alias("kind"), expected_path(F.col("expected_filepath")).alias("path"))
    h = hits.select(F.col("query_id").alias("case_id"), "path", "rank")
    return g.join(h, ["case_id", "path"], "left").groupBy("case_id", "kind").agg(F.min("rank").alias("rank"))


def retrieval_metrics(golden: DataFrame, hits: DataFrame, slices: tuple = ("kind",)) -> DataFrame:
    """slice columns (null: all cases), cases, recall, mrr, and whether both gates hold. One pass by grouping sets."""
    r = case_ranks(golden, hits)
    m = r.rollup(*slices).agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"))
    return m.withColumn("passed", (F.col("recall") >= GATES["recall"]) & (F.col("mrr") >= GATES["mrr"]))


def route_accuracy(golden: DataFrame) -> DataFrame:
    """cases, accuracy of router cases (query, expected_route)."""
    r = golden.where("kind = 'router' AND expected_route IS NOT NULL")
    return r.agg(F.count(F.lit(1)).alias("cases"), F.avg((T.route_query(F.col("query")) == F.col("expected_route")).cast("double")).alias("accuracy"))


#: Folders that a citation may name first.
ROOTS = ("rag/documents/", "documents/", "skill/", "router/")


def citation_check(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """claim_key, citation, valid of (claim_key, citation) against known paths (path).

    A citation is a path, with or without one of four prefixes, and an optional fragment that is neither empty nor holds control characters. A semi join on the path decides.
    """
    c = F.replace(F.trim("citation"), F.lit("\\"), F.lit("/"))
    path, tail = F.regexp_extract(c, "^([^#]*)", 1), F.regexp_extract(c, "^[^#]*#(.*)$", 1)
    has = F.contains(c, F.lit("#"))
    parts = F.split(path, "/")
    bad = (path == "") | path.rlike("^(/|[A-Za-z]:[/\\\\])") | F.exists(parts, lambda s: s.isin("", ".", "..")) | (has & ((tail == "") | tail.rlike(r"[\x00-\x1F]")))
    rows = citations.select("claim_key", "citation", F.coalesce(bad, F.lit(True)).alias("bad"), path.alias("_path"))
    bare = F.regexp_replace("_path", "^(rag/documents/|documents/|skill/|router/)", "")
    keys = rows.where("NOT bad").select("_path", F.explode(F.array_distinct(F.array(F.col("_path"), bare))).alias("path"))
    known = keys.join(docs.select("path"), "path", "left_semi").select(F.col("_path").alias("_known")).distinct()
    both = rows.join(known, rows["_path"] == known["_known"], "left")
    return both.select("claim_key", "citation", (~F.col("bad") & F.col("_known").isNotNull()).alias("valid"))


def response_metrics(claims: DataFrame, golden: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: claims, supported, fidelity, citation_required, citation_supported, coverage, critical_failures, missing_citations, status.

    claims: (case_id, claim_id, supported, critical, requires_citation, citations). Where requires_citation is null, all but conceptual cases require one.
    Metrics without denominator are null; status is failed below a gate, on a critical failure or a supported claim without a valid citation that needs one.
    """
    c = claims.withColumn("claim_key", F.concat_ws("/", "case_id", "claim_id"))
    valid = citation_check(c.select("claim_key", F.explode("citations").alias("citation")), docs).where("valid").select("claim_key").distinct().withColumn("cited", F.lit(True))
    g = golden.select("case_id", F.coalesce("kind", F.lit("factual")).alias("kind"), F.coalesce("critical", F.lit(False)).alias("case_critical"))
    r = c.join(g, "case_id", "left").join(valid, "claim_key", "left")
    needs = F.coalesce("requires_citation", F.coalesce("kind", F.lit("factual")) != "conceptual")
    critical = F.coalesce("case_critical", F.lit(False)) | F.coalesce("critical", F.lit(False))
    cited = F.coalesce("cited", F.lit(False))
    m = r.agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("supported").alias("supported"), F.count_if(needs).alias("citation_required"), F.count_if(needs & cited).alias("citation_supported"),
        F.count_if(critical & ~F.col("supported")).alias("critical_failures"), F.count_if(needs & ~cited & F.col("supported")).alias("missing_citations"),
    )
    m = m.withColumns({"fidelity": F.try_divide("supported", "claims"), "coverage": F.try_divide("citation_supported", "citation_required")})
    below = (F.coalesce(F.col("fidelity"), F.lit(1.0)) < GATES["response_fidelity"]) | (F.coalesce(F.col("coverage"), F.lit(1.0)) < GATES["citation_coverage"])
    failed = below | (F.col("critical_failures") > 0) | (F.col("missing_citations") > 0)
    return m.withColumn("status", F.when(failed, "failed").when(F.col("claims") > 0, "passed").otherwise("not_applicable"))


def leak_check(golden: DataFrame, hits: DataFrame, blocked: DataFrame) -> DataFrame:
    """case_id, code, sources: critical cases that were not retrieved, forbidden sources that were, and revoked documents in the corpus (case_id null)."""
    ranks = case_ranks(golden, hits)
    critical = golden.where(F.coalesce("critical", F.lit(False)) & F.coalesce("must_retrieve", F.lit(True)))
    failed = critical.select("case_id").join(ranks.where("rank IS NOT NULL"), "case_id", "left_anti").select("case_id", F.lit("CRITICAL_CASE_FAILED").alias("code"), F.array().cast("array<string>").alias("sources"))
    forbidden = golden.select("case_id", F.coalesce("critical", F.lit(False)).alias("critical"), F.explode("forbidden_sources").alias("path"))
    leaks = forbidden.join(hits.select(F.col("query_id").alias("case_id"), "path").distinct(), ["case_id", "path"]).groupBy("case_id", "critical").agg(F.array_sort(F.collect_set("path")).alias("sources"))
    leaks = leaks.select("case_id", F.when(F.col("critical"), "CRITICAL_SOURCE_LEAK").otherwise("SOURCE_LEAK").alias("code"), "sources")
    revoked = blocked.agg(F.array_sort(F.collect_set("path")).alias("sources")).where("size(sources) > 0").select(F.lit(None).cast("long").alias("case_id"), F.lit("CRITICAL_REVOCATION_LEAK").alias("code"), "sources")
    return failed.unionByName(leaks).unionByName(revoked)


def golden_candidates(docs: DataFrame, package: str = "source_id", limit: int = 20) -> DataFrame:
    """package, query, expected_filepath, kind, reviewed: titles (or file names) of the first documents of each package by path, to be reviewed."""
    order = Window.partitionBy(package).orderBy("path")
    first = docs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    title = T.markdown_title(F.col("content"), T.file_stem(F.col("path")))
    return first.select(package, title.alias("query"), F.col("path").alias("expected_filepath"), F.lit("factual").alias("kind"), F.lit(False).alias("reviewed"))


def theme_candidates(themes: DataFrame) -> DataFrame:
    """theme, query: one candidate for each question of a theme (theme, questions array)."""
    return themes.select("theme", F.explode("questions").alias("query")).where("trim(query) <> ''").distinct()


def link_check(docs: DataFrame) -> DataFrame:
    """path, target, code: relative links to missing files, out of the root, or to missing anchors, of Markdown documents (path, content).

    Links and anchors come from the rows themselves; both checks are equi joins on paths and (path, anchor).
    """
    from .normalize import extract_links

    links = extract_links(docs).where("NOT target_path RLIKE '^(http://|https://|mailto:|app://)' AND (target_path <> '' OR fragment <> '')")
    folder = F.regexp_replace("path", "[^/]*$", "")
    joined = F.split(F.concat(folder, "target_path"), "/")

    def step(acc, s):
        up = s == ".."
        out = F.when(up & (F.size(acc["parts"]) == 0), acc["parts"]).when(up, F.slice(acc["parts"], 1, F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))).when(s.isin("", "."), acc["parts"]).otherwise(F.concat(acc["parts"], F.array(s)))
        return F.struct(out.alias("parts"), (acc["outside"] | (up & (F.size(acc["parts"]) == 0))).alias("outside"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("outside"))
    links = links.withColumn("r", F.aggregate(joined, start, step))
    links = links.withColumn("to", F.when(F.col("target_path") == "", F.col("path")).otherwise(F.array_join("r.parts", "/")))
    heads = F.filter(T.lines(F.col("content")), lambda x: x.rlike(r"^#{1,6}\s+.+"))
    anchors = docs.select(F.col("path").alias("to"), F.explode(F.transform(heads, lambda x: T.heading_anchor(F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s+", ""), r"\s*#*\s*$", "")))).alias("fragment"))
    ids = docs.select(F.col("path").alias("to"), F.explode(F.regexp_extract_all("content", F.lit("""(?i)(?:id|name)=['"]([^'"]+)['"]"""), F.lit(1))).alias("fragment"))
    anchors = anchors.unionByName(ids).where("fragment <> ''").distinct().withColumn("_anchor", F.lit(True))
    known = docs.select(F.col("path").alias("to")).distinct().withColumn("_known", F.lit(True))
    l = links.join(known, "to", "left").join(anchors, ["to", "fragment"], "left")
    code = (
        F.when((F.col("target_path") != "") & F.col("r.outside"), "link_outside_root").when((F.col("target_path") != "") & F.col("_known").isNull(), "broken_local_link")
        .when((F.col("fragment") != "") & F.col("_anchor").isNull(), "broken_local_anchor")
    )
    return l.select("path", "target", code.alias("code")).where("code IS NOT NULL")
