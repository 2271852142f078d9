"""Tables that the queries derive from the given ones, as DataFrames and as DuckDB SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R

#: Fixed value: the time at which everything is judged.
NOW = "2024-01-20 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d) -> DataFrame:
    """doc_id, path, content, source_id, lang."""
    t = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.select("doc_id", path.alias("path"), F.col("text").alias("content"), F.col("source").alias("source_id"), "lang")


CORPUS = "corpus AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path, text AS content, source AS source_id, lang FROM documents)"


def marked(spark, d) -> DataFrame:
    """The corpus with headings, links and time marks: of its lines every third is a heading, every fifth links to a document, every seventh begins with a time."""
    lines = F.split("content", "\n")
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.when(i % 2 == 0, "## ").otherwise("# "), x)).when(i % 5 == 1, F.concat(F.lit("see [this]("), F.when(i % 2 == 0, F.concat(F.lit("doc-"), (F.col("doc_id") + i).cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("../../x-"), i.cast("string"), F.lit(".md#part"))), F.lit(") "), x)).when(i % 7 == 2, F.concat(F.lit("[00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(" - 01:10] "), x)).otherwise(x)
    return corpus(spark, d).withColumn("content", F.array_join(F.transform(lines, line), "\n"))


MARKED = (
    CORPUS
    + r""",
marked AS (SELECT doc_id, path, source_id, lang, array_to_string(list_transform(string_split(content, chr(10)), lambda x, j:
  CASE WHEN (j - 1) % 3 = 0 THEN (CASE WHEN (j - 1) % 2 = 0 THEN '## ' ELSE '# ' END) || x
       WHEN (j - 1) % 5 = 1 THEN 'see [this](' || (CASE WHEN (j - 1) % 2 = 0 THEN 'doc-' || (doc_id + j - 1) || '.md' ELSE '../../x-' || (j - 1) || '.md#part' END) || ') ' || x
       WHEN (j - 1) % 7 = 2 THEN '[00:' || lpad(CAST((j - 1) % 60 AS VARCHAR), 2, '0') || ' - 01:10] ' || x ELSE x END), chr(10)) AS content FROM corpus)"""
)


def urls(spark, d) -> DataFrame:
    """page_id, url: each page's URL as it is, with upper-case scheme, fragment, default port, blanks and slash, credentials, a private host, and one that is no URL of a page."""
    u = F.col("url")
    forms = F.array(
        u, F.regexp_replace(u, "^https?", "HTTPS"), F.concat(u, F.lit("#top")), F.regexp_replace(u, "^(https?)(://[^/]+)", "https$2:443"), F.concat(F.lit("  "), u, F.lit("// ")),
        F.concat(F.regexp_replace(u, "#.*$", ""), F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit("api_key=abc&b=1")), F.regexp_replace(u, "://[^/]+", "://10.1.2.3:8080"), F.regexp_replace(u, "://", "://me:pw@"), F.concat(F.lit("mailto:p"), F.col("page_id").cast("string"), F.lit("@example.org")),
    )
    return table(spark, d, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))


URLS = r"""urls AS (SELECT page_id, unnest(range(0, 9)) AS form, unnest([url, regexp_replace(url, '^https?', 'HTTPS'), url || '#top', regexp_replace(url, '^(https?)(://[^/]+)', 'https\2:443'), '  ' || url || '// ',
  regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api_key=abc&b=1', regexp_replace(url, '://[^/]+', '://10.1.2.3:8080'), regexp_replace(url, '://', '://me:pw@'), 'mailto:p' || page_id || '@example.org']) AS url FROM pages)"""


def canonical_sql(u: str) -> str:
    """canonicalize_url as DuckDB SQL."""
    t = f"trim({u})"
    scheme = f"lower(regexp_extract({t}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    netloc = f"regexp_extract({t}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = f"regexp_replace(regexp_extract({t}, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1), '/+$', '')"
    query = f"regexp_extract({t}, '^[^?#]*\\?([^#]*)', 1)"
    host = f"lower({netloc})"
    port = f"regexp_extract({host}, ':([0-9]+)$', 1)"
    place = f"CASE WHEN contains({netloc}, '@') THEN {netloc} WHEN ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') OR {port} = '' THEN regexp_replace({host}, ':[0-9]*$', '') ELSE {host} END"
    return f"(CASE WHEN {scheme} IN ('http', 'https') THEN {scheme} || '://' || ({place}) || (CASE WHEN {path} = '' THEN '/' ELSE {path} END) || (CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END) ELSE {t} END)"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


TOKEN = r"[\p{L}\p{N}_À-ÿ][\p{L}\p{N}_À-ÿ./:-]*"


def tokens_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all({fold_sql(x)}, '{TOKEN}'))"


def lines_sql(x: str) -> str:
    """Lines of a text whose only line ends are LF."""
    return f"(CASE WHEN {x} = '' THEN [] WHEN ends_with({x}, chr(10)) THEN string_split(left({x}, length({x}) - 1), chr(10)) ELSE string_split({x}, chr(10)) END)"


def questions(spark, d) -> DataFrame:
    """query_id, query: the first eight words of the benchmark passages, and every fifth passage's first three between route words."""
    words = F.split("text", " ")
    text = F.array_join(F.slice(words, 1, 8), " ")
    text = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("how default "), F.array_join(F.slice(words, 1, 3), " "))).when(F.col("item_id") % 5 == 1, F.concat(F.lit("Update "), F.array_join(F.slice(words, 1, 3), " "))).otherwise(text)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))


QUESTIONS = """questions AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN 'how default ' || array_to_string(string_split(text, ' ')[1:3], ' ')
  WHEN item_id % 5 = 1 THEN 'Update ' || array_to_string(string_split(text, ' ')[1:3], ' ') ELSE array_to_string(string_split(text, ' ')[1:8], ' ') END AS query FROM benchmark)"""


def records(spark, d, current: bool) -> DataFrame:
    """package_id, canonical, version, content_hash, destination of two states of the corpus: the later one lacks every 7th document, has every 11th changed and every 13th moved."""
    c = corpus(spark, d)
    k = F.col("doc_id")
    moved = F.when(k % 13 == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")) if current else F.col("path")
    text = F.when(k % 11 == 4, F.concat("content", F.lit("!"))).otherwise(F.col("content")) if current else F.col("content")
    rows = c.select(F.col("source_id").alias("package_id"), F.concat(F.lit("HTTP://Docs.Example.org/"), "path", F.lit("/")).alias("canonical"), F.when(k % 4 == 0, "1.0").alias("version"), F.upper(F.sha2(text, 256)).alias("content_hash"), moved.alias("destination"), "doc_id", "path", text.alias("content"))
    return rows.where(k % 7 != 2) if current else rows.where(k % 9 != 5)


def records_sql(current: bool) -> str:
    text = "CASE WHEN doc_id % 11 = 4 THEN content || '!' ELSE content END" if current else "content"
    dest = "CASE WHEN doc_id % 13 = 3 THEN 'moved/' || path ELSE path END" if current else "path"
    where = "doc_id % 7 <> 2" if current else "doc_id % 9 <> 5"
    return f"""SELECT source_id AS package_id, 'HTTP://Docs.Example.org/' || path || '/' AS canonical, CASE WHEN doc_id % 4 = 0 THEN '1.0' END AS version, upper(sha256({text})) AS content_hash, {dest} AS destination, doc_id, path, {text} AS content
FROM corpus WHERE {where}"""


RECORDS = CORPUS + ", prev AS (" + records_sql(False) + "), cur AS (" + records_sql(True) + ")"


def entries(spark, d) -> DataFrame:
    """package_id, seq, source, canonical, version, destination, status, content_hash of the corpus as acquired: canonical URLs and destinations repeat, some entries fail."""
    k = F.col("doc_id")
    status = F.when(k % 10 == 9, "error").when(k % 17 == 5, "quarantined").when(k % 23 == 7, "ignored").otherwise("accepted")
    return corpus(spark, d).select(
        F.col("source_id").alias("package_id"), k.alias("seq"), "path", F.concat(F.lit("file:///repo/"), "path").alias("source"), F.concat(F.lit("https://docs.example.org/"), (k % 50).cast("string")).alias("canonical"),
        F.when(k % 4 == 0, "1.0").alias("version"), F.concat(F.lit("guide/page-"), (k % 20).cast("string"), F.lit(".md")).alias("destination"), status.alias("status"),
    )


ENTRIES = (
    CORPUS
    + """, entries AS (SELECT source_id AS package_id, doc_id AS seq, path, 'file:///repo/' || path AS source, 'https://docs.example.org/' || (doc_id % 50) AS canonical, CASE WHEN doc_id % 4 = 0 THEN '1.0' END AS version,
  'guide/page-' || (doc_id % 20) || '.md' AS destination, CASE WHEN doc_id % 10 = 9 THEN 'error' WHEN doc_id % 17 = 5 THEN 'quarantined' WHEN doc_id % 23 = 7 THEN 'ignored' ELSE 'accepted' END AS status FROM corpus)"""
)


def events(spark, d) -> DataFrame:
    """event_id, seq, package_id, type, observed_revision, policy_revision, occurred_at, payload_hash, document_id, revision, base_revision, impact, revoked, completed, deferred: the event stream, every 12th event sent twice, every 24th with another content."""
    t = table(spark, d, "events")
    k = F.col("event_id")
    bucket = F.get_json_object("props", "$.k").cast("long")
    t = t.select("*", bucket.alias("k")).withColumn("copy", F.explode(F.when(k % 12 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    body = F.concat_ws("|", "event_type", F.col("user_id").cast("string"), "props", F.when((F.col("copy") == 1) & (k % 24 == 0), "changed").otherwise(""))
    kind = F.col("event_type")
    return t.select(
        k.cast("string").alias("event_id"), (k * 2 + F.col("copy")).alias("seq"), (F.col("user_id") % 40).alias("package_id"), kind.alias("type"), F.concat(F.lit("r"), (F.col("k") % 5).cast("string")).alias("observed_revision"),
        F.when(F.col("k") % 3 == 0, "p1").alias("policy_revision"), F.col("ts").cast("timestamp").alias("occurred_at"), F.sha2(body, 256).alias("payload_hash"), F.concat(F.lit("doc-"), F.col("k").cast("string")).alias("document_id"),
        F.concat(F.lit("v"), (k % 4).cast("string")).alias("revision"), F.lit("v1").alias("base_revision"),
        F.when(kind == "error", "uncertain").when(kind.isin("view", "click"), "conceptual").when(kind == "purchase", "factual").otherwise("Conceptual").alias("impact"), ((kind == "signup") & (k % 3 == 0)).alias("revoked"),
        F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("f"), (F.col("k") % 6).cast("string")))).otherwise(F.array().cast("array<string>")).alias("completed"), F.array(F.concat(F.lit("f"), (F.col("k") % 4).cast("string"))).alias("deferred"), "user_id", "value",
    )


EVENTS = """ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev1 AS (SELECT *, unnest(CASE WHEN event_id % 12 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM ev0),
ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id * 2 + copy AS seq, user_id % 40 AS package_id, event_type AS type, 'r' || (k % 5) AS observed_revision, CASE WHEN k % 3 = 0 THEN 'p1' END AS policy_revision, ts AS occurred_at,
  sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR), props, CASE WHEN copy = 1 AND event_id % 24 = 0 THEN 'changed' ELSE '' END)) AS payload_hash, 'doc-' || k AS document_id, 'v' || (event_id % 4) AS revision, 'v1' AS base_revision,
  CASE WHEN event_type = 'error' THEN 'uncertain' WHEN event_type IN ('view', 'click') THEN 'conceptual' WHEN event_type = 'purchase' THEN 'factual' ELSE 'Conceptual' END AS impact, event_type = 'signup' AND event_id % 3 = 0 AS revoked,
  CASE WHEN k % 2 = 0 THEN ['f' || (k % 6)] ELSE [] END AS completed, ['f' || (k % 4)] AS deferred, user_id, value FROM ev1)"""


def feedback(spark, d) -> DataFrame:
    """Normalized submissions from the event stream: feedback_id, event_id, seq, package_id, kind, subject_hash, question_hash, occurrence_hash, content_hash, latency_ms, cost_units, occurred_at."""
    e = events(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("wrong_answer", "retrieval_miss", "unhelpful", "abstention", "latency", "cost"))), (F.length("type") % 6 + 1).cast("int"))
    q = F.sha2("document_id", 256)
    return e.select(
        F.concat(F.lit("fb-"), "event_id").alias("feedback_id"), F.concat(F.lit("ev-"), "event_id").alias("event_id"), "seq", "package_id", kind.alias("kind"), F.sha2((F.col("user_id") % 12).cast("string"), 256).alias("subject_hash"),
        q.alias("question_hash"), F.sha2(F.concat_ws("|", F.col("package_id").cast("string"), kind, q, (F.col("user_id") % 25).cast("string")), 256).alias("occurrence_hash"), F.col("payload_hash").alias("content_hash"),
        F.col("value").alias("latency_ms"), F.when(F.col("seq") % 3 == 0, F.col("value") / 4).alias("cost_units"), "occurred_at",
    )


FEEDBACK = (
    EVENTS
    + """, fb AS (SELECT 'fb-' || event_id AS feedback_id, 'ev-' || event_id AS event_id, seq, package_id, ['wrong_answer', 'retrieval_miss', 'unhelpful', 'abstention', 'latency', 'cost'][length(type) % 6 + 1] AS kind, sha256(CAST(user_id % 12 AS VARCHAR)) AS subject_hash,
  sha256(document_id) AS question_hash, sha256(concat_ws('|', CAST(package_id AS VARCHAR), ['wrong_answer', 'retrieval_miss', 'unhelpful', 'abstention', 'latency', 'cost'][length(type) % 6 + 1], sha256(document_id), CAST(user_id % 25 AS VARCHAR))) AS occurrence_hash,
  payload_hash AS content_hash, value AS latency_ms, CASE WHEN seq % 3 = 0 THEN value / 4 END AS cost_units, occurred_at FROM ev)"""
)


def sources(spark, d) -> DataFrame:
    """Suppliers as governed sources: source_id, canonical, destination, observed_revision, source_type, authority_class, published_at, lifecycle, valid_from, valid_until, privacy, retention_until, status, revoked."""
    k = F.col("s_suppkey")
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, d, "supplier").select(
        k.alias("source_id"), F.concat(F.lit("https://source.example.org/"), k.cast("string")).alias("canonical"), F.concat(F.lit("rag/documents/s-"), k.cast("string"), F.lit(".md")).alias("destination"), F.concat(F.lit("rev-"), (k % 3).cast("string")).alias("observed_revision"),
        F.when(k % 4 == 0, "official_documentation").when(k % 4 == 1, "article").otherwise("study").alias("source_type"), F.when(k % 3 == 0, "official").otherwise("community").alias("authority_class"),
        F.concat(F.lit("20"), (20 + k % 5).cast("string"), F.lit("-05-01")).alias("published_at"), F.when(k % 13 == 1, "archived").when(k % 17 == 2, "revoked").otherwise("active").alias("lifecycle"),
        F.when(k % 5 == 0, day(k % 40)).alias("valid_from"), F.when(k % 6 == 0, day(k % 50)).alias("valid_until"), F.when(k % 8 == 0, "unknown").otherwise("public").alias("privacy"), F.when(k % 9 == 0, day(k % 60)).alias("retention_until"),
        F.when(k % 19 == 3, "withdrawn").otherwise("active").alias("status"), (k % 29 == 4).alias("revoked"),
    )


SOURCES = """src AS (SELECT s_suppkey AS source_id, 'https://source.example.org/' || s_suppkey AS canonical, 'rag/documents/s-' || s_suppkey || '.md' AS destination, 'rev-' || (s_suppkey % 3) AS observed_revision,
  CASE WHEN s_suppkey % 4 = 0 THEN 'official_documentation' WHEN s_suppkey % 4 = 1 THEN 'article' ELSE 'study' END AS source_type, CASE WHEN s_suppkey % 3 = 0 THEN 'official' ELSE 'community' END AS authority_class,
  '20' || (20 + s_suppkey % 5) || '-05-01' AS published_at, CASE WHEN s_suppkey % 13 = 1 THEN 'archived' WHEN s_suppkey % 17 = 2 THEN 'revoked' ELSE 'active' END AS lifecycle,
  CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 40 AS INTEGER)) END AS valid_from, CASE WHEN s_suppkey % 6 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 50 AS INTEGER)) END AS valid_until,
  CASE WHEN s_suppkey % 8 = 0 THEN 'unknown' ELSE 'public' END AS privacy, CASE WHEN s_suppkey % 9 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 60 AS INTEGER)) END AS retention_until,
  CASE WHEN s_suppkey % 19 = 3 THEN 'withdrawn' ELSE 'active' END AS status, s_suppkey % 29 = 4 AS revoked FROM supplier)"""


def grants(spark, d) -> DataFrame:
    """Orders as grants: source_id, position, purpose, decision, evidence_ref, actor, valid_from, valid_until, review_after, regions."""
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("o_orderkey")
    purpose = F.element_at(F.array(*map(F.lit, ("capture", "storage", "indexing", "internal_query", "quotation", "derivatives", "redistribution"))), (k % 7 + 1).cast("int"))
    day = lambda m: F.timestamp_add("DAY", m, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, d, "orders").join(F.broadcast(n), F.lit(True)).select(
        (F.col("o_custkey") % F.col("n")).alias("source_id"), k.alias("position"), purpose.alias("purpose"), F.when(F.col("o_orderstatus") == "F", "denied").otherwise("allowed").alias("decision"), F.when(k % 10 != 0, "evidence").alias("evidence_ref"), F.when(k % 11 != 0, "clerk").alias("actor"),
        F.when(k % 4 == 0, day(k % 30)).alias("valid_from"), F.when(k % 3 != 0, day(10 + k % 60)).alias("valid_until"), F.when(k % 5 == 0, day(k % 70)).alias("review_after"), F.when(k % 6 == 0, F.array(F.lit("R1"), F.lit("R2"))).when(k % 6 == 1, F.array(F.lit("R3"))).otherwise(F.array().cast("array<string>")).alias("regions"),
    )


GRANTS = """gr AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS source_id, o_orderkey AS position, ['capture', 'storage', 'indexing', 'internal_query', 'quotation', 'derivatives', 'redistribution'][o_orderkey % 7 + 1] AS purpose,
  CASE WHEN o_orderstatus = 'F' THEN 'denied' ELSE 'allowed' END AS decision, CASE WHEN o_orderkey % 10 <> 0 THEN 'evidence' END AS evidence_ref, CASE WHEN o_orderkey % 11 <> 0 THEN 'clerk' END AS actor,
  CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS valid_from, CASE WHEN o_orderkey % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(10 + o_orderkey % 60 AS INTEGER)) END AS valid_until,
  CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 70 AS INTEGER)) END AS review_after, CASE WHEN o_orderkey % 6 = 0 THEN ['R1', 'R2'] WHEN o_orderkey % 6 = 1 THEN ['R3'] ELSE [] END AS regions FROM orders),
purposes AS (SELECT unnest(['acquisition', 'storage', 'indexing', 'internal_query', 'quotation', 'derivatives', 'redistribution']) AS purpose),
gi AS (SELECT *, CASE WHEN purpose = 'capture' THEN 'acquisition' ELSE purpose END AS p, decision = 'allowed' AND evidence_ref IS NULL AS i1, decision = 'allowed' AND actor IS NULL AS i2, decision = 'allowed' AND valid_until IS NULL AND review_after IS NULL AS i3 FROM gr),
gl AS (SELECT * FROM gi QUALIFY row_number() OVER (PARTITION BY source_id, p ORDER BY position DESC) = 1),
ng AS (SELECT s.source_id, q.purpose, CASE WHEN l.i1 OR l.i2 OR l.i3 THEN 'unknown' ELSE coalesce(l.decision, 'unknown') END AS decision, l.valid_from, l.valid_until, l.review_after, coalesce(l.regions, []) AS regions,
  list_filter([CASE WHEN l.i1 THEN 'allowed_requires_evidence_ref' END, CASE WHEN l.i2 THEN 'allowed_requires_actor' END, CASE WHEN l.i3 THEN 'allowed_requires_expiry_or_review' END], lambda x: x IS NOT NULL) AS issues
  FROM (SELECT DISTINCT source_id FROM src) s CROSS JOIN purposes q LEFT JOIN gl l ON l.source_id = s.source_id AND l.p = q.purpose)"""


def normal_grants(spark, d) -> DataFrame:
    from ..operators.governance import normalize_grants

    return normalize_grants(grants(spark, d), sources(spark, d))


def decisions(spark, d, region: str | None = "R1") -> DataFrame:
    from ..operators.governance import use_decision

    s = sources(spark, d)
    return use_decision(s, s.where("source_id % 37 <> 5"), s.select("source_id", "status"), normal_grants(spark, d), s.where("revoked").select("source_id"), F.lit(NOW).cast("timestamp"), region)


DECISIONS = (
    SOURCES
    + ", "
    + GRANTS
    + f""", dj AS MATERIALIZED (SELECT s.source_id, g.purpose, s.source_id % 37 = 5 AS unknown_, s.status, s.revoked, s.lifecycle, s.valid_from AS sf, s.valid_until AS su, s.privacy, s.retention_until, g.decision, g.valid_from, g.valid_until, g.review_after, g.regions FROM src s JOIN ng g USING (source_id)),
dr AS (SELECT source_id, purpose, CASE WHEN unknown_ THEN 'RIGHTS_BLOCKED/governance_unknown' WHEN status IN ('withdrawn', 'revoked', 'archived', 'inactive') THEN 'SOURCE_REVOKED/registry_source_inactive' WHEN revoked OR lifecycle = 'revoked' THEN 'SOURCE_REVOKED/source_revoked'
  WHEN lifecycle = 'archived' AND purpose NOT IN ('acquisition', 'storage') THEN 'SOURCE_ARCHIVED/source_archived' WHEN sf > TIMESTAMP '{NOW}' OR su <= TIMESTAMP '{NOW}' THEN 'EVIDENCE_STALE/source_validity_inactive'
  WHEN decision <> 'allowed' THEN 'RIGHTS_BLOCKED/grant_unknown_or_denied' WHEN valid_from > TIMESTAMP '{NOW}' THEN 'RIGHTS_BLOCKED/grant_not_yet_valid' WHEN valid_until <= TIMESTAMP '{NOW}' THEN 'RIGHTS_BLOCKED/grant_expired'
  WHEN review_after <= TIMESTAMP '{NOW}' THEN 'RIGHTS_BLOCKED/grant_review_due' WHEN len(regions) > 0 AND NOT list_contains(regions, 'R1') THEN 'RIGHTS_BLOCKED/region_not_allowed'
  WHEN privacy = 'unknown' AND purpose IN ('storage', 'indexing', 'redistribution') THEN 'PRIVACY_BLOCKED/privacy_unknown' WHEN retention_until <= TIMESTAMP '{NOW}' THEN 'PRIVACY_BLOCKED/retention_expired' ELSE 'ALLOWED' END AS r FROM dj),
de AS (SELECT source_id, purpose, r = 'ALLOWED' AS allowed, split_part(r, '/', 1) AS code, nullif(split_part(r, '/', 2), '') AS reason FROM dr)"""
)


def claims(spark, d) -> DataFrame:
    """Parts as claims: claim_id, text, classification, region, valid_from, valid_until."""
    k = F.col("p_partkey")
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    kind = F.element_at(F.array(*map(F.lit, ("official_rule", "factual_observation", "recommendation", "experience", "opinion", "hypothesis"))), (k % 6 + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("claim_id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), kind.alias("classification"), F.when(k % 4 == 0, "R1").when(k % 4 == 1, "R2").alias("region"), F.when(k % 5 == 0, day(k % 35)).alias("valid_from"), F.when(k % 7 == 0, day(k % 45)).alias("valid_until"))


CLAIMS = """cl AS (SELECT p_partkey AS claim_id, concat_ws(' ', p_name, p_brand) AS text, ['official_rule', 'factual_observation', 'recommendation', 'experience', 'opinion', 'hypothesis'][p_partkey % 6 + 1] AS classification, CASE WHEN p_partkey % 4 = 0 THEN 'R1' WHEN p_partkey % 4 = 1 THEN 'R2' END AS region,
  CASE WHEN p_partkey % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 35 AS INTEGER)) END AS valid_from, CASE WHEN p_partkey % 7 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 45 AS INTEGER)) END AS valid_until FROM part)"""


def refs(spark, d) -> DataFrame:
    """Line items as references of claims to sources: claim_id, source_id, observed_revision, document_id."""
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("claim_id"), F.col("l_suppkey").alias("source_id"), F.when(k % 5 == 0, F.lit("rev-0")).when(k % 5 == 1, F.concat(F.lit("rev-"), (F.col("l_suppkey") % 3).cast("string"))).alias("observed_revision"), F.concat(F.lit("d-"), (k % 9).cast("string")).alias("document_id")).distinct()


REFS = "rf AS (SELECT DISTINCT l_partkey AS claim_id, l_suppkey AS source_id, CASE WHEN l_orderkey % 5 = 0 THEN 'rev-0' WHEN l_orderkey % 5 = 1 THEN 'rev-' || (l_suppkey % 3) END AS observed_revision, 'd-' || (l_orderkey % 9) AS document_id FROM lineitem)"


def conflicts(spark, d) -> DataFrame:
    """Customers as conflicts between claims: conflict_id, claim_ids, relation, status, resolution, reviewer_ref."""
    n = table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("c_custkey")
    return table(spark, d, "customer").join(F.broadcast(n), F.lit(True)).select(
        F.concat(F.lit("c-"), k.cast("string")).alias("conflict_id"), F.array(k % F.col("n"), (k * 7 + 3) % F.col("n"), (k * k) % F.col("n")).alias("claim_ids"), F.when(k % 3 == 0, "contradicts").when(k % 3 == 1, "supersedes").when(k % 12 == 2, "odd").otherwise("scope_difference").alias("relation"),
        F.when(k % 4 == 0, "resolved").otherwise("open").alias("status"), F.when(k % 8 == 0, "kept").alias("resolution"), F.when(k % 16 == 0, "reviewer").alias("reviewer_ref"),
    )


CONFLICTS = """cf AS (SELECT 'c-' || c_custkey AS conflict_id, [c_custkey % n, (c_custkey * 7 + 3) % n, (c_custkey * c_custkey) % n] AS claim_ids, CASE WHEN c_custkey % 3 = 0 THEN 'contradicts' WHEN c_custkey % 3 = 1 THEN 'supersedes' WHEN c_custkey % 12 = 2 THEN 'odd' ELSE 'scope_difference' END AS relation,
  CASE WHEN c_custkey % 4 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN c_custkey % 8 = 0 THEN 'kept' END AS resolution, CASE WHEN c_custkey % 16 = 0 THEN 'reviewer' END AS reviewer_ref FROM customer, (SELECT count(*) AS n FROM part))"""


def golden(spark, d, index=None) -> DataFrame:
    """case_id, query, expected_filepath, kind, expected_route, critical, must_retrieve, reviewed, forbidden_sources, set_id of the questions; the expected path is that of the first document that holds the passage, if there is one. A written table: what joins it several times searches the texts once."""
    from ..operators.graph import cut
    from ..operators.retrieval import phrase_hits

    q = questions(spark, d)
    c = corpus(spark, d)
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    where = phrase_hits(b, c, fold=False, index=index).join(c.select("path", "doc_id"), "path").groupBy(F.col("query_id").alias("case_id")).agg(F.min_by("path", "doc_id").alias("found"))
    k = F.col("case_id")
    g = q.withColumnRenamed("query_id", "case_id").join(where, "case_id", "left")
    route = F.element_at(F.array(*map(F.lit, ("lifecycle", "both", "rag", "skill"))), (k % 4 + 1).cast("int"))
    g = g.select(
        "case_id", "query", F.concat(F.lit("documents/"), F.coalesce("found", F.lit("src0/none.md"))).alias("expected_filepath"), F.when(k % 5 < 2, "router").when(k % 5 == 2, "conceptual").otherwise("factual").alias("kind"), F.when(k % 5 < 2, route).alias("expected_route"),
        (k % 6 == 0).alias("critical"), (k % 12 != 0).alias("must_retrieve"), (k % 9 != 0).alias("reviewed"), F.when(k % 3 == 0, F.array(F.coalesce("found", F.lit("src0/none.md")))).otherwise(F.array().cast("array<string>")).alias("forbidden_sources"), (k % 8).alias("set_id"),
    )
    return cut(g)


GOLDEN = """gw AS (SELECT b.item_id AS case_id, arg_min(c.path, c.doc_id) AS found FROM benchmark b JOIN corpus c ON contains(c.content, b.text) GROUP BY 1),
golden AS (SELECT query_id AS case_id, query, 'documents/' || coalesce(found, 'src0/none.md') AS expected_filepath, CASE WHEN query_id % 5 < 2 THEN 'router' WHEN query_id % 5 = 2 THEN 'conceptual' ELSE 'factual' END AS kind,
  CASE WHEN query_id % 5 < 2 THEN ['lifecycle', 'both', 'rag', 'skill'][query_id % 4 + 1] END AS expected_route, query_id % 6 = 0 AS critical, query_id % 12 <> 0 AS must_retrieve, query_id % 9 <> 0 AS reviewed,
  CASE WHEN query_id % 3 = 0 THEN [coalesce(found, 'src0/none.md')] ELSE [] END AS forbidden_sources, query_id % 8 AS set_id FROM questions LEFT JOIN gw ON gw.case_id = query_id)"""

#: The ranking of retrieval.rank_documents for the questions, as SQL: hits(query_id, path, score, rank).
HITS = f"""qt AS (SELECT query_id, query, {tokens_sql('query')} AS ts FROM questions),
dt AS (SELECT path, content, {tokens_sql('content')} AS ct, {tokens_sql('path')} AS pt FROM corpus),
sc AS (SELECT query_id, path, len(list_intersect(ts, ct)) / greatest(len(ts), 1) + len(list_intersect(ts, pt)) / greatest(len(ts), 1) * 0.5 + CASE WHEN contains({fold_sql('content')}, {fold_sql('query')}) THEN 0.5 ELSE 0 END AS score FROM qt CROSS JOIN dt),
hits AS (SELECT * FROM (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM sc) WHERE rank <= 5)"""


def hits(spark, d, index=None) -> DataFrame:
    from ..operators.retrieval import rank_documents

    return rank_documents(questions(spark, d), corpus(spark, d), 5, index)


def golden_and_hits(spark, d) -> tuple[DataFrame, DataFrame]:
    """Both from one index of the tokens of questions, and of passages to look up phrases, so texts are cut into tokens once."""
    from ..functions import text as T
    from ..operators.lexical_index import build_index

    of = lambda df, c: df.select(F.explode(T.tokens(F.col(c))).alias("token"))
    index = build_index(corpus(spark, d), of(questions(spark, d), "query"), of(table(spark, d, "benchmark"), "text"))
    both = golden(spark, d, index), hits(spark, d, index)
    index.drop()
    return both


def hash_of(*columns: str):
    return R.canonical_hash({c: F.col(c) for c in columns})
