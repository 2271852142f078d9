"""Queries of identity, retrieval, evaluation, governance and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import governance as G
from ..operators import graph
from ..operators import identity as D
from ..operators import retrieval as L
from ..operators.sql import register_functions
from . import inputs as I
from .registry import query


def now():
    return F.lit(I.NOW).cast("timestamp")


# --- identity -------------------------------------------------------------------------------------------------------

_KEY = f"{I.canonical_sql('canonical')} || chr(0) || coalesce(version, '')"
_STATE = f"""WITH {I.RECORDS}, pk AS (SELECT package_id, {_KEY} AS k, sha256({_KEY} || chr(0) || lower(content_hash)) AS i, destination FROM prev WHERE package_id IN (SELECT package_id FROM cur) AND package_id <> 'src3'),
ck AS (SELECT package_id, {_KEY} AS k, sha256({_KEY} || chr(0) || lower(content_hash)) AS i, destination FROM cur WHERE package_id <> 'src3'),
j AS (SELECT coalesce(c.package_id, p.package_id) AS package_id, coalesce(c.k, p.k) AS logical_key, CASE WHEN p.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' WHEN p.i <> c.i OR p.destination <> c.destination THEN 'updated' END AS action, p.destination AS old_destination, c.destination AS new_destination FROM pk p FULL JOIN ck c ON p.package_id = c.package_id AND p.k = c.k)"""


@query("j1_state_diff", _STATE + " SELECT package_id, sha256(logical_key) AS h, action, old_destination, new_destination FROM j WHERE action IS NOT NULL")
def j1(spark, d):
    failed = spark.createDataFrame([("src3",)], "package_id string")
    cols = ["package_id", "canonical", "version", "content_hash", "destination"]
    r = D.state_diff(I.records(spark, d, False).select(*cols), I.records(spark, d, True).select(*cols), failed)
    return r.select("package_id", F.sha2("logical_key", 256).alias("h"), "action", "old_destination", "new_destination")


@query("o1_plan_actions", _STATE + " SELECT row_number() OVER (ORDER BY coalesce(new_destination, old_destination), action, sha256(logical_key)) AS position, action, coalesce(new_destination, old_destination) AS destination FROM j WHERE action IS NOT NULL QUALIFY position <= 100")
def o1(spark, d):
    cols = ["package_id", "canonical", "version", "content_hash", "destination"]
    r = D.state_diff(I.records(spark, d, False).select(*cols), I.records(spark, d, True).select(*cols), spark.createDataFrame([("src3",)], "package_id string"))
    from pyspark.sql import Window

    place = F.coalesce("new_destination", "old_destination")
    top = r.select("action", place.alias("destination"), F.sha2("logical_key", 256).alias("h")).orderBy("destination", "action", "h").limit(100)
    return top.withColumn("position", F.row_number().over(Window.orderBy("destination", "action", "h")).cast("long")).select("position", "action", "destination")


@query(
    "j2_file_diff",
    f"WITH {I.RECORDS} SELECT coalesce(p.package_id, c.package_id) AS package_id, coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'add' WHEN c.path IS NULL THEN 'remove' ELSE 'update' END AS action FROM prev p FULL JOIN cur c ON p.package_id = c.package_id AND p.path = c.path WHERE p.path IS NULL OR c.path IS NULL OR p.content_hash <> c.content_hash",
)
def j2(spark, d):
    side = lambda current: I.records(spark, d, current).select("package_id", "path", F.col("content_hash").alias("sha256"))
    return D.file_diff(side(False), side(True))


@query(
    "o4_removed_paths",
    f"WITH {I.RECORDS} SELECT package_id, path FROM prev EXCEPT SELECT package_id, path FROM cur",
)
def o4(spark, d):
    return I.records(spark, d, False).select("package_id", "path").exceptAll(I.records(spark, d, True).select("package_id", "path"))


@query("j15_artifact_drift", f"WITH {I.RECORDS}, x AS (SELECT coalesce(p.package_id, c.package_id) AS package_id, coalesce(p.path, c.path) AS path FROM prev p FULL JOIN cur c ON p.package_id = c.package_id AND p.path = c.path WHERE p.path IS NULL OR c.path IS NULL OR p.content_hash <> c.content_hash) SELECT package_id, 'skill_update_requires_review' AS code, string_agg(path, '|' ORDER BY path) AS artifacts FROM x GROUP BY 1")
def j15(spark, d):
    side = lambda current: I.records(spark, d, current).select("package_id", "path", F.col("content_hash").alias("sha256"))
    return D.artifact_drift(side(False), side(True)).withColumn("artifacts", F.array_join("artifacts", "|"))


@query("w2_dedupe_records", f"WITH {I.ENTRIES}, r AS (SELECT package_id, {I.canonical_sql('canonical')} || chr(0) || coalesce(version, '') AS k, min(path) AS destination FROM entries GROUP BY 1, 2) SELECT package_id, sha256(k) AS h, destination FROM r")
def w2(spark, d):
    e = I.entries(spark, d).select("package_id", "canonical", "version", F.sha2("path", 256).alias("content_hash"), F.col("path").alias("destination"))
    return D.dedupe_records(D._keyed(e)).select("package_id", F.sha2("logical_key", 256).alias("h"), "destination")


@query(
    "w3_dedupe_canonical",
    f"WITH {I.ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY package_id, canonical, status = 'accepted' ORDER BY seq) AS n FROM entries) SELECT package_id, seq, CASE WHEN status = 'accepted' AND n > 1 THEN 'ignored' ELSE status END AS status, CASE WHEN status = 'accepted' AND n > 1 THEN 'duplicate-canonical' END AS reason FROM n",
)
def w3(spark, d):
    return D.dedupe_canonical(I.entries(spark, d)).select("package_id", "seq", "status", "reason")


#: Every third entry wants a page of another folder, every seventh a name without folder, every eleventh one that looks as if it had been made for another entry.
_WANTED = """CASE WHEN seq % 11 = 4 THEN 'page-' || (seq % 4) || '--' || left(sha256('file:///repo/' || (seq % 5)), 10) || CASE WHEN seq % 2 = 0 THEN '-2' ELSE '' END || '.md' WHEN seq % 7 = 1 THEN 'page-' || (seq % 4) || '.md' WHEN seq % 3 = 0 THEN 'manual/page-' || (seq % 4) || '.md' ELSE 'guide/page-' || (seq % 4) || '.md' END"""


@query(
    "w4_unique_destinations",
    f"""WITH RECURSIVE {I.ENTRIES}, w AS (SELECT package_id, seq, {_WANTED} AS destination, left(sha256('file:///repo/' || (seq % 5)), 10) AS dg, row_number() OVER (PARTITION BY package_id ORDER BY seq) AS i FROM entries),
m AS (SELECT *, regexp_extract(destination, '([^/]*)\\.md$', 1) || '--' || dg AS made FROM w),
s AS (SELECT package_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS final_destination FROM (SELECT DISTINCT package_id FROM m)
UNION ALL SELECT package_id, i, seq, list_append(used, own), own FROM (SELECT m.package_id, m.i, m.seq, used, CASE WHEN NOT list_contains(used, destination) THEN destination ELSE list_filter([made || '.md'] || list_transform(range(2, 2 + len(used)), lambda n: made || '-' || n || '.md'), lambda x: NOT list_contains(used, x))[1] END AS own
  FROM s JOIN m ON m.package_id = s.package_id AND m.i = s.i + 1))
SELECT package_id, seq, final_destination FROM s WHERE i > 0""",
)
def w4(spark, d):
    k = F.col("seq")
    at = lambda n: (k % n).cast("string")
    source = F.concat(F.lit("file:///repo/"), at(5))
    made = F.concat(F.lit("page-"), at(4), F.lit("--"), F.substring(F.sha2(source, 256), 1, 10), F.when(k % 2 == 0, "-2").otherwise(""), F.lit(".md"))
    page = F.concat(F.lit("page-"), at(4), F.lit(".md"))
    wanted = F.when(k % 11 == 4, made).when(k % 7 == 1, page).when(k % 3 == 0, F.concat(F.lit("manual/"), page)).otherwise(F.concat(F.lit("guide/"), page))
    return D.unique_destinations(I.entries(spark, d).withColumns({"source": source, "destination": wanted})).select("package_id", "seq", "final_destination")


@query("o7_snapshot_documents", f"WITH {I.RECORDS}, b AS (SELECT DISTINCT package_id FROM cur WHERE doc_id % 97 = 8) SELECT package_id, path, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS size FROM cur WHERE package_id NOT IN (SELECT package_id FROM b)")
def o7(spark, d):
    c = I.records(spark, d, True)
    return D.snapshot_documents(c.select("package_id", "path", "content"), c.where("doc_id % 97 = 8").select("package_id", "path"))


_SNAP = "sha256('{\"corpus_hash\":\"' || c || '\",\"embedding\":\"e' || n % 5 || '\",\"release_id\":\"release-' || n || '\"}')"


@query(
    "o7_validate_snapshot",
    f"""WITH {I.RECORDS}, n AS (SELECT package_id, length(package_id) + ascii(right(package_id, 1)) AS n FROM (SELECT DISTINCT source_id AS package_id FROM corpus)),
h AS (SELECT 1 AS old, package_id, sha256('[' || string_agg('["' || path || '","' || sha256(content) || '"]', ',' ORDER BY path) || ']') AS c FROM prev GROUP BY 2 UNION ALL SELECT 0, package_id, sha256('[' || string_agg('["' || path || '","' || sha256(content) || '"]', ',' ORDER BY path) || ']') FROM cur GROUP BY 2),
i AS (SELECT old, package_id, n, {_SNAP} AS id FROM h JOIN n USING (package_id)), p AS (SELECT package_id, n, id FROM i WHERE old = CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END)
SELECT p.package_id, CASE WHEN c.id IS NULL OR c.id <> p.id THEN 'rag_snapshot_incompatible' WHEN p.n % 4 = 1 THEN 'rag_snapshot_revoked' END AS code FROM p LEFT JOIN i c ON c.package_id = p.package_id AND c.old = 0""",
)
def o7b(spark, d):
    n = F.length("package_id") + F.ascii(F.substring("package_id", -1, 1))
    p = I.corpus(spark, d).select(F.col("source_id").alias("package_id")).distinct()
    headers = p.select("package_id", F.concat(F.lit("e"), (n % 5).cast("string")).alias("embedding"), F.concat(F.lit("release-"), n.cast("string")).alias("release_id"))
    ids = lambda current: D.snapshot_ids(D.snapshot_documents(I.records(spark, d, current).select("package_id", "path", "content")), headers)
    pinned = ids(False).where(n % 3 == 0).unionByName(ids(True).where(n % 3 != 0)).withColumn("revocation_hash", F.sha2("package_id", 256))
    active = p.select("package_id", F.sha2(F.when(n % 4 == 1, F.concat("package_id", F.lit("!"))).otherwise(F.col("package_id")), 256).alias("revocation_hash"))
    return D.validate_snapshot(pinned, ids(True), active)


@query("a2_corpus_hash", f"WITH {I.RECORDS} SELECT package_id, count(*) AS documents, CAST(sum(strlen(content)) AS BIGINT) AS bytes, sha256('[' || string_agg('[\"' || path || '\",\"' || sha256(content) || '\"]', ',' ORDER BY path) || ']') AS corpus_hash FROM cur GROUP BY 1")
def a2(spark, d):
    return D.corpus_hash(D.snapshot_documents(I.records(spark, d, True).select("package_id", "path", "content")))


_TREE = """t4 AS (SELECT package_id, left(sha256(path), 4) AS node, sha256(string_agg(path || ':' || h, chr(10) ORDER BY path || ':' || h)) AS hash FROM now GROUP BY 1, 2)""" + "".join(
    f", t{n} AS (SELECT package_id, left(node, {n}) AS node, sha256(string_agg(node || ':' || hash, chr(10) ORDER BY node)) AS hash FROM t{n + 1} GROUP BY 1, 2)" for n in (3, 2, 1, 0)
)


@query(
    "a2_tree_refresh",
    f"""WITH {I.RECORDS}, now AS (SELECT package_id, path, sha256(content) AS h FROM cur), old AS (SELECT package_id, path, sha256(content) AS h FROM prev), {_TREE},
ch AS (SELECT coalesce(now.package_id, old.package_id) AS package_id, coalesce(now.path, old.path) AS path FROM now FULL JOIN old ON now.package_id = old.package_id AND now.path = old.path WHERE now.h IS DISTINCT FROM old.h),
w AS (SELECT DISTINCT package_id, left(sha256(path), n) AS node FROM ch, (SELECT unnest([0, 1, 2, 3, 4]) AS n))
SELECT coalesce(t0.package_id, w.package_id) AS package_id, any_value(t0.hash) AS root, count(w.node) AS touched FROM t0 FULL JOIN w USING (package_id) GROUP BY 1""",
)
def a2c(spark, d):
    """The tree of the earlier state, brought up to the later one by the nodes that its changes touch."""
    of = lambda current: D.snapshot_documents(I.records(spark, d, current).select("package_id", "path", "content")).select("package_id", "path", "sha256")
    old, new = of(False), of(True)
    both = old.select("package_id", "path", F.col("sha256").alias("_old")).join(new, ["package_id", "path"], "full")
    changed = both.where(~F.col("_old").eqNullSafe(F.col("sha256"))).select("package_id", "path")
    tree = D.hash_tree(old)
    touched = D.refresh_tree(tree, new, changed)
    root = D.apply_refresh(tree, touched).where("node = ''").select("package_id", F.col("hash").alias("root"))
    return root.join(touched.groupBy("package_id").agg(F.count(F.lit(1)).alias("touched")), "package_id", "full").select("package_id", "root", F.coalesce("touched", F.lit(0)).cast("long").alias("touched"))


@query(
    "a2_tree_hash",
    f"WITH {I.RECORDS}, l AS (SELECT package_id, left(sha256(path), 2) AS b, sha256('[' || string_agg('[\"' || path || '\",\"' || sha256(content) || '\"]', ',' ORDER BY path) || ']') AS h FROM cur GROUP BY 1, 2) SELECT package_id, sha256('[' || string_agg('[\"' || b || '\",\"' || h || '\"]', ',' ORDER BY b) || ']') AS tree_hash FROM l GROUP BY 1",
)
def a2b(spark, d):
    return D.tree_hash(D.snapshot_documents(I.records(spark, d, True).select("package_id", "path", "content")))


_LAYERS = """l AS (SELECT s_suppkey AS package_id, ['corpus', 'index', 'skill', 'router', 'policy', 'golden'][(s_nationkey % 6) + 1] AS layer, 'r' || s_nationkey AS revision FROM supplier UNION ALL SELECT s_suppkey, 'corpus', 'c' || (s_suppkey % 5) FROM supplier WHERE s_nationkey % 6 <> 0),
p AS (SELECT package_id, coalesce(max(revision) FILTER (WHERE layer = 'corpus'), 'unknown') AS c, coalesce(max(revision) FILTER (WHERE layer = 'index'), 'unknown') AS i, coalesce(max(revision) FILTER (WHERE layer = 'skill'), 'unknown') AS s, coalesce(max(revision) FILTER (WHERE layer = 'router'), 'unknown') AS r, coalesce(max(revision) FILTER (WHERE layer = 'policy'), 'default-policy-v1') AS p, coalesce(max(revision) FILTER (WHERE layer = 'golden'), 'unknown') AS g FROM l GROUP BY 1)"""


def _composed(c: str) -> str:
    return f"""sha256('{{"corpus_revision":"' || {c} || '","golden_revision":"' || g || '","index_revision":"' || i || '","policy_revision":"' || p || '","router_revision":"' || r || '","skill_revision":"' || s || '"}}')"""


def _layers(spark, d):
    s = I.table(spark, d, "supplier")
    layer = F.element_at(F.array(*map(F.lit, ("corpus", "index", "skill", "router", "policy", "golden"))), (F.col("s_nationkey") % 6 + 1).cast("int"))
    own = s.select(F.col("s_suppkey").alias("package_id"), layer.alias("layer"), F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("revision"))
    more = s.where("s_nationkey % 6 <> 0").select(F.col("s_suppkey").alias("package_id"), F.lit("corpus").alias("layer"), F.concat(F.lit("c"), (F.col("s_suppkey") % 5).cast("string")).alias("revision"))
    return own.unionByName(more)


@query("a3_package_revisions", f"WITH {_LAYERS}, h AS (SELECT package_id, {_composed('c')} AS composition_hash FROM p) SELECT package_id, composition_hash, 'release-' || left(composition_hash, 24) AS release_id FROM h")
def a3(spark, d):
    return D.package_revisions(_layers(spark, d)).select("package_id", "composition_hash", "release_id")


@query(
    "a3_revision_evidence",
    f"""WITH {_LAYERS}, w AS (SELECT *, CASE WHEN package_id % 3 = 0 AND c LIKE 'c%' THEN 'c1' ELSE c END AS was FROM p), h AS (SELECT *, {_composed('c')} AS now_hash, {_composed('was')} AS then_hash FROM w)
SELECT package_id, CASE WHEN i = 'unknown' AND package_id % 4 = 1 THEN 'incomplete' WHEN now_hash <> then_hash THEN 'invalidated' ELSE 'valid' END AS status FROM h""",
)
def a3b(spark, d):
    layers = _layers(spark, d)
    k = F.col("package_id")
    then = D.package_revisions(layers.withColumn("revision", F.when((k % 3 == 0) & (F.col("layer") == "corpus") & F.col("revision").startswith("c"), "c1").otherwise(F.col("revision"))))
    recorded = then.withColumn("index_revision", F.when(~((F.col("index_revision") == "unknown") & (k % 4 == 1)), F.col("index_revision")))
    return D.revision_evidence(recorded, layers)


def _headers(spark, d, current):
    p = I.corpus(spark, d).select(F.col("source_id").alias("package_id")).distinct()
    n = F.length("package_id") + F.ascii(F.substring("package_id", -1, 1))
    if not current:
        p = p.where(n % 7 != 0)
    v = lambda name, m: F.concat(F.lit(name), F.when((n % 11 == m) & F.lit(current), "2").otherwise("1")).alias(name)
    return p.select("package_id", v("embedding", 1), v("model", 2), v("configuration", 3), v("artifacts", 4), v("revocation", 5), v("backend_snapshot", 6), v("backend_name", 8), v("backend_version", 9), (n % 11 != 10).alias("supports_incremental"))


@query(
    "o6_plan_reuse",
    f"""WITH {I.RECORDS}, h AS (SELECT package_id, length(package_id) + ascii(right(package_id, 1)) AS n FROM (SELECT DISTINCT source_id AS package_id FROM corpus)),
r AS (SELECT package_id, n, CASE WHEN n % 7 = 0 THEN 'no_previous_snapshot' WHEN n % 11 = 1 THEN 'embedding_changed' WHEN n % 11 = 2 THEN 'model_changed' WHEN n % 11 = 3 THEN 'configuration_changed' WHEN n % 11 = 4 THEN 'artifacts_changed' WHEN n % 11 = 5 THEN 'revocation_changed' WHEN n % 11 = 6 THEN 'backend_snapshot_changed' WHEN n % 11 = 8 THEN 'backend_changed' WHEN n % 11 = 9 THEN 'backend_version_changed' WHEN n % 11 = 10 THEN 'backend_incremental_unsupported' ELSE 'incremental_reuse' END AS reason FROM h),
p AS (SELECT prev.* FROM prev JOIN h USING (package_id) WHERE n % 7 <> 0),
c AS (SELECT coalesce(p.package_id, cur.package_id) AS package_id, count(*) FILTER (WHERE p.content_hash = cur.content_hash) AS u, count(*) FILTER (WHERE cur.path IS NOT NULL AND p.content_hash IS DISTINCT FROM cur.content_hash) AS ch, count(*) FILTER (WHERE cur.path IS NULL) AS rm FROM p FULL JOIN cur ON p.package_id = cur.package_id AND p.path = cur.path GROUP BY 1)
SELECT package_id, CASE WHEN reason = 'incremental_reuse' THEN 'incremental' ELSE 'full_rebuild' END AS mode, reason, CASE WHEN reason = 'incremental_reuse' THEN u ELSE 0 END AS reused, ch AS changed, rm AS removed FROM r JOIN c USING (package_id)""",
)
def o6(spark, d):
    side = lambda current: I.records(spark, d, current).select("package_id", "path", F.col("content_hash").alias("sha256"))
    return D.plan_reuse(side(False), side(True), _headers(spark, d, False), _headers(spark, d, True))


@query("a1_manifest_rollup", f"WITH {I.ENTRIES}, n AS (SELECT package_id, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'ignored') AS ignored, count(*) FILTER (WHERE status = 'quarantined') AS quarantined, count(*) FILTER (WHERE status = 'error') AS errors FROM entries GROUP BY 1) SELECT *, CASE WHEN package_id = 'src5' THEN 'blocked' WHEN errors + quarantined > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM n")
def a1(spark, d):
    return D.manifest_rollup(I.entries(spark, d), spark.createDataFrame([("src5", True, False), ("src6", True, True)], "package_id string, requires_decision boolean, selected boolean"))


@query(
    "a13_manifest_integrity",
    f"""WITH {I.ENTRIES}, a AS (SELECT * FROM entries WHERE status = 'accepted'), du AS (SELECT DISTINCT package_id FROM (SELECT package_id FROM a GROUP BY package_id, canonical, coalesce(version, '') HAVING count(*) > 1)),
f AS (SELECT source_id AS package_id, count(*) AS files FROM corpus WHERE doc_id % 10 <> 9 GROUP BY 1), n AS (SELECT package_id, count(*) AS accepted FROM a GROUP BY 1), i AS (SELECT package_id, count(*) AS cd, CASE WHEN package_id = 'src4' THEN 0 ELSE 5 END AS oc, CASE WHEN package_id = 'src2' THEN -1 END AS bd FROM a GROUP BY 1)
SELECT package_id, 'duplicate_source' AS code FROM du UNION ALL SELECT i.package_id, 'manifest_document_count' FROM i JOIN f USING (package_id) JOIN n USING (package_id) WHERE files <> accepted UNION ALL SELECT i.package_id, 'rag_document_count' FROM i JOIN f USING (package_id) WHERE cd <> files
UNION ALL SELECT package_id, 'rag_operator_chunks_invalid' FROM i WHERE oc < 1 UNION ALL SELECT package_id, 'rag_backend_metric_invalid' FROM i WHERE bd < 0""",
)
def a13(spark, d):
    e = I.entries(spark, d)
    docs = I.corpus(spark, d).where("doc_id % 10 <> 9").select(F.col("source_id").alias("package_id"), "path")
    p = F.col("package_id")
    index = e.where("status = 'accepted'").groupBy("package_id").agg(F.count(F.lit(1)).alias("corpus_documents")).select("package_id", "corpus_documents", F.when(p == "src4", 0).otherwise(5).alias("operator_chunks"), F.when(p == "src2", -1).alias("backend_total_documents"), F.lit(None).cast("int").alias("backend_total_chunks"))
    return D.manifest_integrity(e, docs, index)


@query(
    "a14_readiness",
    """WITH p AS (SELECT c_custkey AS k FROM customer), f AS (SELECT k, k % 2 = 0 OR k % 3 = 0 AS sc, k % 3 = 0 AS en, k % 5 <> 1 AS co, k % 4 = 0 AS ix, k % 7 = 0 AS ev, k % 14 <> 7 AS va, k % 21 = 0 AS ba, k % 42 = 0 AS re, ['not-ready', 'indexed', 'corpus-ready'][k % 3 + 1] AS de FROM p),
s AS (SELECT k, de, CASE WHEN re AND ev AND va AND ba AND en AND sc THEN 'release-ready' WHEN ev AND va THEN 'evaluated' WHEN co AND ix THEN 'indexed' WHEN co THEN 'corpus-ready' WHEN en AND sc THEN 'skill-enriched' WHEN sc THEN 'scaffold-ready' ELSE 'not-ready' END AS state FROM f),
o AS (SELECT ['not-ready', 'scaffold-ready', 'skill-enriched', 'corpus-ready', 'indexed', 'evaluated', 'release-ready'] AS o)
SELECT k AS package_id, state, CASE WHEN de = state THEN 'ok' WHEN list_position(o, de) > list_position(o, state) THEN 'over_claim' ELSE 'stale' END AS claim FROM s, o""",
)
def a14(spark, d):
    k = F.col("c_custkey")
    p = I.table(spark, d, "customer").select(
        k.alias("package_id"), ((k % 2 == 0) | (k % 3 == 0)).alias("scaffold"), (k % 3 == 0).alias("enriched"), (k % 5 != 1).alias("corpus_ready"), (k % 4 == 0).alias("indexed"), (k % 7 == 0).alias("evaluation_ok"), (k % 14 != 7).alias("evaluation_valid"), (k % 21 == 0).alias("backend_evidence"),
        (k % 42 == 0).alias("release_validated"), F.element_at(F.array(F.lit("not-ready"), F.lit("indexed"), F.lit("corpus-ready")), (k % 3 + 1).cast("int")).alias("declared"),
    )
    return D.readiness(p)


# --- retrieval ------------------------------------------------------------------------------------------------------

_R1 = f"WITH {I.CORPUS}, {I.QUESTIONS}, {I.HITS}"


@query("r1_rank_documents", _R1 + " SELECT query_id, path, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def r1(spark, d):
    return I.hits(spark, d).select("query_id", "path", F.round("score", 6).alias("score"), "rank")


@query(
    "r2_hit_metadata",
    _R1 + " SELECT query_id, path, CASE WHEN doc_id % 4 <> 1 THEN 'Doc ' || doc_id END AS title, CASE WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 3 = 0 THEN '' ELSE path || '#section=part ' || lang END AS citations FROM hits JOIN corpus USING (path)",
)
def r2(spark, d):
    c = I.corpus(spark, d).where("doc_id % 4 <> 1")
    s = c.select(F.concat(F.lit("./"), "path").alias("destination"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("md").alias("format"), F.lit("accepted").alias("quality_status"), F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("section").alias("kind"), F.lit(" ").alias("label")))).otherwise(F.array(F.struct(F.lit("section").alias("kind"), F.concat(F.lit("part "), "lang").alias("label")), F.struct(F.lit("section").alias("kind"), F.concat(F.lit("part "), "lang").alias("label")))).alias("locators"))
    return L.hit_metadata(I.hits(spark, d), s).select("query_id", "path", "title", F.array_join("citations", "|").alias("citations"))


@query("u1_registered_retriever", _R1 + " SELECT 'memory' AS retriever, query_id, path, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 3")
def u1(spark, d):
    return L.search("memory", I.questions(spark, d), I.corpus(spark, d), 3).select("retriever", "query_id", "path", "rank")


def _hybrid(spark, d):
    L.register_retriever("hybrid", L.hybrid_retriever(_query_vectors(spark, d), _chunks(spark, d), _vectors(spark, d)))
    return L.search("hybrid", I.questions(spark, d), I.corpus(spark, d), 5)


@query("o2_top_terms", f"WITH {I.CORPUS}, t AS (SELECT unnest({I.tokens_sql('content')}) AS token FROM corpus) SELECT token, count(*) AS documents FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def o2(spark, d):
    from ..functions import text as T

    t = I.corpus(spark, d).select(F.explode(T.tokens(F.col("content"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.col("documents").desc(), "token").limit(50)


@query(
    "r4_get_document",
    f"WITH {I.CORPUS} SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'unsafe_path' ELSE 'not_found' END AS status, CASE WHEN doc_id % 3 = 0 THEN sha256(content) END AS h FROM corpus",
)
def r4(spark, d):
    c = I.corpus(spark, d)
    k = F.col("doc_id")
    req = c.select(k.alias("request_id"), F.when(k % 3 == 0, F.concat(F.lit("./"), "path")).when(k % 3 == 1, F.concat(F.lit("../"), "path")).otherwise(F.concat("path", F.lit("x"))).alias("path"))
    return L.get_document(req, c).select("request_id", "status", F.sha2("content", 256).alias("h"))


@query(
    "r5_expand_query",
    f"""WITH {I.QUESTIONS}, t AS (SELECT query_id, unnest({I.tokens_sql('query')}) AS term FROM questions), s AS (SELECT 'how' AS term, 'guide' AS e UNION ALL SELECT 'update', 'refresh'), g AS (SELECT 1 AS g, 'the' AS term UNION ALL SELECT 1, 'and' UNION ALL SELECT 1, 'of'),
p AS (SELECT * FROM s UNION ALL SELECT a.term, b.term FROM g a JOIN g b ON a.g = b.g AND a.term <> b.term), a AS (SELECT query_id, term FROM t UNION SELECT query_id, e FROM t JOIN p USING (term))
SELECT query_id, string_agg(term, ' ' ORDER BY term) AS tokens FROM a GROUP BY 1""",
)
def r5(spark, d):
    s = spark.createDataFrame([("how", "guide"), ("update", "refresh")], "term string, expansion string")
    g = spark.createDataFrame([(1, "the"), (1, "and"), (1, "of")], "group_id int, term string")
    return L.expand_query(I.questions(spark, d), s, g).withColumn("tokens", F.array_join("tokens", " "))


@query("r6_categorize", f"WITH {I.CORPUS}, m AS (SELECT 'src1' AS pattern, 'one' AS category UNION ALL SELECT 'src1/en', 'one-en' UNION ALL SELECT '/de/', 'german'), h AS (SELECT path, category, row_number() OVER (PARTITION BY path ORDER BY length(pattern) DESC, category) AS n FROM corpus LEFT JOIN m ON contains(path, pattern)) SELECT path, category FROM h WHERE n = 1")
def r6(spark, d):
    m = spark.createDataFrame([("src1", "one"), ("src1/en", "one-en"), ("/de/", "german")], "pattern string, category string")
    return L.categorize(I.corpus(spark, d), m)


@query("r7_keyword_routes", f"WITH {I.QUESTIONS}, r AS (SELECT 'how' AS k, 'guides' AS c UNION ALL SELECT 'default', 'reference' UNION ALL SELECT 'update', 'operations') SELECT query_id, coalesce(string_agg(DISTINCT c, ' ' ORDER BY c), '') AS categories FROM questions LEFT JOIN r ON contains(lower(query), k) GROUP BY 1")
def r7(spark, d):
    r = spark.createDataFrame([("how", "guides"), ("Default", "reference"), ("update", "operations")], "keyword string, category string")
    return L.keyword_routes(I.questions(spark, d), r).withColumn("categories", F.array_join("categories", " "))


@query(
    "r8_lexical_fast_path",
    _R1 + " , n AS (SELECT query_id, count(*) FILTER (WHERE score > 0) AS n FROM hits GROUP BY 1) SELECT query_id, CASE WHEN query_id % 3 = 0 AND n >= 3 THEN 'lexical' ELSE 'hybrid' END AS mode FROM n",
)
def r8(spark, d):
    q = I.questions(spark, d)
    marked = q.select("query_id", F.when(F.col("query_id") % 3 == 0, F.lit("why does app.run_now() fail")).otherwise(F.lit("plain words only")).alias("query"))
    return L.lexical_fast_path(marked, I.hits(spark, d))


def _chunks(spark, d):
    from ..operators.normalize import chunk_text

    chunks = chunk_text(I.corpus(spark, d), keep=("doc_id",))
    return chunks.select((F.col("doc_id") * 100_000 + F.col("chunk")).alias("chunk_id"), "text", F.col("path").alias("document"))


_BM25 = rf"""WITH {I.CORPUS}, {I.QUESTIONS}, cs AS (SELECT doc_id, path, content, unnest(range(0, greatest(0, length(content) - 201) + 1, 800)) AS start FROM corpus WHERE trim(content) <> ''), ch AS (SELECT doc_id * 100000 + start // 800 AS chunk_id, regexp_extract_all({I.fold_sql('substr(content, start + 1, 1000)')}, '{I.TOKEN}') AS ts, path AS document FROM cs), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM ch),
tf AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS token FROM ch) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT query_id, unnest({I.tokens_sql('query')}) AS token FROM questions),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean))), 9) AS score FROM qt JOIN tf USING (token) JOIN df USING (token) JOIN ch USING (chunk_id) CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 15)"""


@query("r9_bm25", _BM25 + " SELECT query_id, chunk_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 15")
def r9a(spark, d):
    return L.bm25(I.questions(spark, d), _chunks(spark, d), 15).withColumn("score", F.round("score", 5))


_COS = """cv AS (SELECT vec_id * 100000 AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < (SELECT count(*) FROM benchmark)),
co AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q.e, c.e), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.e, c.e), 9) DESC, chunk_id) AS rank FROM qv q CROSS JOIN cv c QUALIFY rank <= 15)"""


def _query_vectors(spark, d):
    n = I.table(spark, d, "benchmark").count()
    return I.table(spark, d, "embeddings").where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), "embedding")


def _vectors(spark, d):
    return I.table(spark, d, "embeddings").select((F.col("vec_id") * 100_000).alias("chunk_id"), "embedding")


@query("r9_cosine", f"WITH {_COS} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM co")
def r9b(spark, d):
    return L.cosine(_query_vectors(spark, d), _vectors(spark, d), 15).withColumn("score", F.round("score", 6))


_FUSED = (
    _BM25 + ", " + _COS + """, fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM bm a FULL JOIN co b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
fd AS (SELECT query_id, document, chunk_id, score, row_number() OVER (PARTITION BY query_id, document ORDER BY score DESC, chunk_id) AS n FROM fu JOIN ch USING (chunk_id)),
fr AS (SELECT query_id, document, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document) AS rank FROM fd WHERE n = 1)"""
)


@query("r9_hybrid_search", _FUSED + " SELECT query_id, document, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 5")
def r9c(spark, d):
    return L.hybrid_search(I.questions(spark, d), _query_vectors(spark, d), _chunks(spark, d), _vectors(spark, d), 5).withColumn("score", F.round("score", 6))


@query("u1_hybrid_retriever", _FUSED + " SELECT 'hybrid' AS retriever, query_id, document AS path, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 5")
def u1b(spark, d):
    return _hybrid(spark, d).withColumn("score", F.round("score", 6))


@query("u3_sql_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def u3(spark, d):
    register_functions(spark)
    I.table(spark, d, "embeddings").createOrReplaceTempView("docweave_vectors")
    return spark.sql("SELECT a.vec_id, round(cosine(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)), 6) AS score FROM docweave_vectors a JOIN docweave_vectors b ON b.vec_id = a.vec_id + 1")


# --- evaluation -----------------------------------------------------------------------------------------------------

_EV = f"WITH {I.CORPUS}, {I.QUESTIONS}, {I.GOLDEN}, {I.HITS}"
_RK = ", ck AS (SELECT g.case_id, g.kind, min(h.rank) AS rank FROM golden g LEFT JOIN hits h ON h.query_id = g.case_id AND h.path = regexp_replace(g.expected_filepath, '^documents/', '') WHERE g.kind <> 'router' GROUP BY 1, 2)"


@query("a10_retrieval_metrics", _EV + _RK + " SELECT kind, count(*) AS cases, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.85 AND avg(coalesce(1.0 / rank, 0)) >= 0.7 AS passed FROM ck GROUP BY ROLLUP (kind)")
def a10(spark, d):
    return E.retrieval_metrics(*I.golden_and_hits(spark, d)).withColumns({"recall": F.round("recall", 6), "mrr": F.round("mrr", 6)})


@query("a10_case_ranks", _EV + _RK + " SELECT case_id, kind, CAST(rank AS INTEGER) AS rank FROM ck")
def a10b(spark, d):
    return E.case_ranks(*I.golden_and_hits(spark, d))


@query("a10_route_accuracy", f"WITH {I.CORPUS}, {I.QUESTIONS}, {I.GOLDEN} SELECT count(*) AS cases, round(avg(CASE WHEN (CASE WHEN case_id % 5 = 1 THEN 'lifecycle' ELSE 'both' END) = expected_route THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM golden WHERE kind = 'router'")
def a10c(spark, d):
    return E.route_accuracy(I.golden(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


def _response_claims(spark, d):
    g = I.golden(spark, d).select("case_id", "expected_filepath")
    c = g.join(I.refs(spark, d).select("claim_id").distinct(), F.col("claim_id") % 40 == F.col("case_id"))
    k = F.col("claim_id")
    cite = F.when(k % 3 == 0, F.array(F.concat("expected_filepath", F.lit("#section=a")))).when(k % 3 == 1, F.array(F.lit("../x.md"), F.regexp_replace("expected_filepath", "^documents/", ""))).otherwise(F.array(F.lit("no/such.md"), F.concat("expected_filepath", F.lit("#"))))
    return c.select("case_id", k.cast("string").alias("claim_id"), (k % 7 != 0).alias("supported"), (k % 11 == 0).alias("critical"), F.when(k % 4 == 0, k % 8 == 0).alias("requires_citation"), cite.alias("citations"))


_RESP = (
    f"WITH {I.CORPUS}, {I.QUESTIONS}, {I.GOLDEN}, {I.REFS}"
    + """, rc AS (SELECT case_id, kind, critical AS cc, expected_filepath, claim_id AS k, replace(expected_filepath, 'documents/', '') IN (SELECT path FROM corpus) AND claim_id % 3 < 2 AS cited, claim_id % 7 <> 0 AS supported, claim_id % 11 = 0 AS critical, CASE WHEN claim_id % 4 = 0 THEN claim_id % 8 = 0 ELSE kind <> 'conceptual' END AS needs FROM golden JOIN (SELECT DISTINCT claim_id FROM rf) ON claim_id % 40 = case_id)"""
)


@query(
    "a11_response_metrics",
    _RESP + """, m AS (SELECT count(*) AS claims, count(*) FILTER (WHERE supported) AS supported, count(*) FILTER (WHERE needs) AS citation_required, count(*) FILTER (WHERE needs AND cited) AS citation_supported, count(*) FILTER (WHERE (cc OR critical) AND NOT supported) AS critical_failures, count(*) FILTER (WHERE needs AND NOT cited AND supported) AS missing_citations FROM rc)
SELECT *, round(supported / claims, 6) AS fidelity, round(citation_supported / citation_required, 6) AS coverage, CASE WHEN supported / claims < 0.98 OR citation_supported / citation_required < 0.98 OR critical_failures > 0 OR missing_citations > 0 THEN 'failed' ELSE 'passed' END AS status FROM m""",
)
def a11(spark, d):
    return E.response_metrics(_response_claims(spark, d), I.golden(spark, d), I.corpus(spark, d)).withColumns({"fidelity": F.round("fidelity", 6), "coverage": F.round("coverage", 6)})


@query("j11_citation_check", _RESP + " SELECT case_id || '/' || k AS claim_key, count(*) FILTER (WHERE cited) AS valid FROM rc GROUP BY 1")
def j11(spark, d):
    c = _response_claims(spark, d).select(F.concat_ws("/", "case_id", "claim_id").alias("claim_key"), F.explode("citations").alias("citation"))
    return E.citation_check(c, I.corpus(spark, d)).groupBy("claim_key").agg(F.count_if("valid").alias("valid"))


@query(
    "a12_leak_check",
    _EV + _RK + """ SELECT case_id, 'CRITICAL_CASE_FAILED' AS code, '' AS sources FROM golden WHERE critical AND must_retrieve AND case_id NOT IN (SELECT case_id FROM ck WHERE rank IS NOT NULL)
UNION ALL SELECT g.case_id, CASE WHEN g.critical THEN 'CRITICAL_SOURCE_LEAK' ELSE 'SOURCE_LEAK' END, h.path FROM golden g JOIN hits h ON h.query_id = g.case_id AND list_contains(g.forbidden_sources, h.path) UNION ALL SELECT NULL, 'CRITICAL_REVOCATION_LEAK', string_agg(path, '|' ORDER BY path) FROM corpus WHERE doc_id % 211 = 5""",
)
def a12(spark, d):
    return E.leak_check(*I.golden_and_hits(spark, d), I.corpus(spark, d).where("doc_id % 211 = 5").select("path")).withColumn("sources", F.array_join("sources", "|"))


@query("a15_golden_candidates", f"WITH {I.MARKED}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY path) AS n, list_filter({I.lines_sql('content')}, lambda x: regexp_matches(x, '^\\s*#\\s+(.+?)\\s*$')) AS t FROM marked) SELECT source_id, coalesce(trim(regexp_extract(t[1], '^\\s*#\\s+(.+?)\\s*$', 1)), 'doc-' || doc_id) AS query, path AS expected_filepath, 'factual' AS kind, false AS reviewed FROM n WHERE n <= 5")
def a15(spark, d):
    return E.golden_candidates(I.marked(spark, d), limit=5)


@query("a15_theme_candidates", f"WITH {I.QUESTIONS} SELECT DISTINCT 'theme-' || (query_id % 4) AS theme, query FROM questions WHERE trim(query) <> ''")
def a15b(spark, d):
    t = I.questions(spark, d).groupBy(F.concat(F.lit("theme-"), (F.col("query_id") % 4).cast("string")).alias("theme")).agg(F.collect_list("query").alias("questions"))
    return E.theme_candidates(t)


@query("a16_citation_sets", f"WITH {I.REFS} SELECT claim_id, string_agg(DISTINCT source_id || '#section=' || document_id, '|' ORDER BY source_id || '#section=' || document_id) AS citations FROM rf GROUP BY 1")
def a16(spark, d):
    from ..functions import records as R

    c = R.citation(F.col("source_id").cast("string"), F.lit("section"), F.col("document_id"))
    return I.refs(spark, d).groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set(c)), "|").alias("citations"))


@query(
    "j10_link_check",
    f"""WITH {I.MARKED}, l AS (SELECT path, unnest(regexp_extract_all(content, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS target FROM marked)
SELECT path, target, CASE WHEN starts_with(target, '../../') THEN 'broken_local_link' ELSE 'broken_local_link' END AS code FROM l WHERE starts_with(target, '../../') OR (regexp_extract(path, '^(.*/)', 1) || target) NOT IN (SELECT path FROM corpus)""",
)
def j10(spark, d):
    return E.link_check(I.marked(spark, d))


# --- governance -----------------------------------------------------------------------------------------------------


@query("l6_normalize_grants", f"WITH {I.SOURCES}, {I.GRANTS} SELECT source_id, purpose, decision, array_to_string(issues, '|') AS issues, array_to_string(regions, '|') AS regions FROM ng")
def l6(spark, d):
    return I.normal_grants(spark, d).select("source_id", "purpose", "decision", F.array_join("issues", "|").alias("issues"), F.array_join("regions", "|").alias("regions"))


@query(
    "l6_normalize_governance",
    f"WITH {I.SOURCES} SELECT source_id, CASE WHEN source_id % 10 = 1 THEN 'published_at' WHEN source_id % 10 = 2 THEN 'published_at' WHEN valid_until < valid_from THEN 'validity.until' WHEN source_id % 11 = 4 THEN 'authority_class' END AS error FROM src",
)
def l6b(spark, d):
    k = F.col("source_id")
    s = I.sources(spark, d)
    return G.normalize_governance(s.select(k.cast("string").alias("source_id"), "source_type", F.when(k % 10 == 1, "unknown").when(k % 10 == 2, "timestamp").otherwise("date").alias("published_precision"), "published_at", "valid_from", "valid_until", "privacy", "lifecycle", F.when(k % 11 == 4, "odd").otherwise(F.col("authority_class")).alias("authority_class"))).withColumn("source_id", F.col("source_id").cast("long"))


@query("j4_use_decision", f"WITH {I.DECISIONS} SELECT source_id, purpose, allowed, code, reason FROM de")
def j4(spark, d):
    return I.decisions(spark, d)


@query(
    "a6_register_sources",
    f"""WITH {I.SOURCES}, o AS (SELECT source_id, status, canonical, 'web' AS kind, CASE WHEN source_id % 5 = 0 THEN 'unknown' ELSE 'mit' END AS rights FROM src WHERE source_id % 4 <> 1), n AS (SELECT source_id, CASE WHEN source_id % 7 = 0 THEN canonical || '/x' ELSE canonical END AS canonical, source_id % 2 = 0 AS readmit, CASE WHEN source_id % 5 = 1 THEN 'unknown' ELSE 'cc' END AS rights FROM src WHERE source_id % 6 <> 2),
c AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, o.status, o.rights AS r0, n.rights AS r1, CASE WHEN n.source_id IS NULL THEN 'unchanged' WHEN o.source_id IS NULL THEN 'source_registered' WHEN o.canonical <> n.canonical THEN 'source_conflict' WHEN o.status = 'withdrawn' AND NOT n.readmit THEN 'source_readmission_required' WHEN o.status = 'withdrawn' AND n.rights = 'unknown' THEN 'source_not_admitted' ELSE 'source_registered' END AS code FROM o FULL JOIN n ON o.source_id = n.source_id)
SELECT source_id, code, CASE WHEN code = 'source_registered' THEN 'active' ELSE status END AS status, CASE WHEN code = 'source_registered' THEN r1 ELSE r0 END AS rights FROM c""",
)
def a6(spark, d):
    k = F.col("source_id")
    s = I.sources(spark, d)
    common = {"kind": F.lit("web"), "scope": F.lit("/**"), "version_policy": F.lit("latest"), "privacy": F.lit("public"), "authority": F.lit("operator"), "owner": F.lit("local")}
    old = s.where(k % 4 != 1).withColumns(common | {"rights": F.when(k % 5 == 0, "unknown").otherwise("mit")})
    new = s.where(k % 6 != 2).withColumns(common | {"canonical": F.when(k % 7 == 0, F.concat("canonical", F.lit("/x"))).otherwise(F.col("canonical")), "readmit": k % 2 == 0, "rights": F.when(k % 5 == 1, "unknown").otherwise("cc")})
    return G.register_sources(old, new).select("source_id", "code", "status", "rights")


@query(
    "a5_reconcile_sources",
    f"""WITH {I.SOURCES}, sn AS (SELECT o_custkey % 150 AS source_id, o_orderkey AS seq, o_orderdate AS t, CASE WHEN o_orderkey % 9 = 0 THEN '/a' ELSE '/**' END AS scope, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'partial' ELSE 'complete' END AS completeness, CASE WHEN o_orderkey % 3 = 0 THEN 'v' || (o_orderkey % 4) END AS version, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 3 END AS n, o_orderkey % 14 = 0 AS w FROM orders),
l AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY t DESC, seq DESC) = 1),
r AS (SELECT l.source_id, s.status, CASE WHEN s.source_id % 2 = 0 THEN 'v0' END AS v0, s.source_id % 3 = 0 AS pinned, l.version, CASE WHEN s.source_id IS NULL THEN 'source_not_registered' WHEN s.status = 'withdrawn' THEN 'source_withdrawn_before' WHEN s.privacy = 'unknown' THEN 'source_not_admitted' WHEN l.scope <> '/**' THEN 'scope_mismatch' WHEN completeness <> 'complete' THEN 'acquisition_incomplete'
  WHEN s.source_id % 3 = 0 AND l.version IS NOT NULL AND l.version IS DISTINCT FROM (CASE WHEN s.source_id % 2 = 0 THEN 'v0' END) THEN 'version_pinned' WHEN n = 0 AND NOT w THEN 'withdrawal_confirmation_required' WHEN w THEN 'source_withdrawn' ELSE 'source_reconciled' END AS code FROM l LEFT JOIN src s USING (source_id))
SELECT source_id, code, CASE WHEN code = 'source_withdrawn' THEN 'withdrawn' ELSE status END AS status, CASE WHEN code IN ('source_withdrawn', 'source_reconciled') AND NOT pinned AND version IS NOT NULL THEN version ELSE v0 END AS version FROM r""",
)
def a5(spark, d):
    k = F.col("source_id")
    reg = I.sources(spark, d).select("source_id", "status", F.lit("/**").alias("scope"), F.when(k % 3 == 0, "pinned").otherwise("latest").alias("version_policy"), F.when(k % 2 == 0, "v0").alias("version"), F.lit("mit").alias("rights"), "privacy", F.lit("operator").alias("authority"), F.lit("local").alias("owner"))
    o = F.col("o_orderkey")
    snap = I.table(spark, d, "orders").select((F.col("o_custkey") % 150).alias("source_id"), o.alias("seq"), F.col("o_orderdate").alias("observation_time"), F.when(o % 9 == 0, "/a").otherwise("/**").alias("scope"), F.when((F.col("o_orderstatus") == "O") & (o % 4 == 0), "partial").otherwise("complete").alias("completeness"), F.when(o % 3 == 0, F.concat(F.lit("v"), (o % 4).cast("string"))).alias("version"), F.when(o % 7 == 0, 0).otherwise(3).alias("n_entries"), (o % 14 == 0).alias("withdraw"))
    return G.reconcile_sources(reg, snap)


def _catalog(spark, d):
    k = F.col("p_partkey")
    return I.table(spark, d, "part").select(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), k.cast("string")).alias("slug"), F.array(F.col("p_name"), F.col("p_brand")).alias("aliases"), (k % 2 == 0).alias("official"), F.round(0.5 + (k % 50) / 100, 2).alias("confidence"))


_CAT = "ct AS (SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS slug, [p_name, p_brand] AS aliases, p_partkey % 2 = 0 AS official, round(0.5 + (p_partkey % 50) / 100, 2) AS confidence FROM part), nm AS (SELECT DISTINCT slug, official, confidence, trim(regexp_replace(lower(unnest(list_concat([slug], aliases))), '[^a-z0-9]+', ' ', 'g')) AS name FROM ct), qs AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN 'brand ' || (c_custkey % 25) WHEN c_custkey % 3 = 1 THEN (SELECT any_value(slug) FROM ct WHERE ends_with(slug, '-' || (c_custkey % 90))) ELSE 'nothing here' END AS query FROM customer)"


@query(
    "j3_resolve_sources",
    f"""WITH {_CAT}, h AS (SELECT DISTINCT query_id, slug, official, confidence FROM (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN 'brand ' || (c_custkey % 30) ELSE 'large ring' END AS query FROM customer) JOIN nm ON nm.name = query),
r AS (SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS nx, count(*) OVER (PARTITION BY query_id) AS candidates FROM h WINDOW w AS (PARTITION BY query_id ORDER BY confidence DESC, slug))
SELECT c_custkey AS query_id, CASE WHEN coalesce(round(confidence - nx, 9) <= 0.05, false) THEN NULL ELSE slug END AS slug, CASE WHEN slug IS NULL THEN 'source_not_found' WHEN coalesce(round(confidence - nx, 9) <= 0.05, false) THEN 'requires_decision' WHEN NOT official THEN 'not_official' ELSE 'resolved' END AS status, coalesce(candidates, 0) AS candidates FROM customer LEFT JOIN r ON query_id = c_custkey AND n = 1""",
)
def j3(spark, d):
    k = F.col("c_custkey")
    q = I.table(spark, d, "customer").select(k.alias("query_id"), F.when(k % 2 == 0, F.concat(F.lit("Brand#"), (k % 30).cast("string"))).otherwise(F.lit(" Large  RING ")).alias("query"))
    return G.resolve_sources(q, _catalog(spark, d))


@query(
    "u2_registered_resolver",
    f"WITH {_CAT}, h AS (SELECT DISTINCT query_id, slug, official, confidence FROM (SELECT s_suppkey AS query_id, 'brand ' || (s_suppkey % 30) AS query FROM supplier) JOIN nm ON nm.name = query) SELECT query_id, 'catalog' AS provider, slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, slug) AS INTEGER) AS rank FROM h",
)
def u2(spark, d):
    from ..functions import text as T

    cat = _catalog(spark, d)
    names = cat.select("slug", "official", "confidence", F.explode(F.transform("aliases", T.normalise_name)).alias("name"))
    G.register_resolver("catalog", lambda q: q.select("query_id", T.normalise_name(F.col("query")).alias("name")).join(names, "name"))
    q = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("query"))
    return G.resolve_with(q, ["catalog"]).select("query_id", "provider", "slug", "rank")


@query("w6_ambiguity_gap", f"WITH {_CAT} SELECT slug, confidence, round(confidence - lead(confidence) OVER (ORDER BY confidence DESC, slug), 6) <= 0.05 AS close FROM (SELECT DISTINCT slug, confidence FROM nm WHERE name = 'large ring')")
def w6(spark, d):
    from pyspark.sql import Window

    c = _catalog(spark, d).where(F.array_contains("aliases", "large ring"))
    # the next confidence below, from one row a confidence; of equal ones all but the last have a neighbour at no distance
    levels = c.groupBy("confidence").agg(F.max("slug").alias("last"))
    lower = levels.select("confidence", "last", F.lead("confidence").over(Window.orderBy(F.col("confidence").desc())).alias("lower"))  # at most as many rows as there are confidences
    gap = F.when(F.col("slug") < F.col("last"), F.lit(0.0)).otherwise(F.col("confidence") - F.col("lower"))
    return c.join(lower, "confidence").select("slug", "confidence", (F.round(gap, 6) <= 0.05).alias("close"))


_ELIG = f"""WITH {I.DECISIONS}, {I.CLAIMS}, {I.REFS}, es AS MATERIALIZED (SELECT s.* FROM src s JOIN de ON de.source_id = s.source_id AND de.purpose = 'internal_query' AND de.allowed),
sup AS MATERIALIZED (SELECT DISTINCT claim_id, es.source_type, es.authority_class, es.published_at FROM rf JOIN es ON es.source_id = rf.source_id WHERE rf.observed_revision IS NULL OR rf.observed_revision = es.observed_revision),
el AS MATERIALIZED (SELECT * FROM cl WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{I.NOW}') AND (valid_until IS NULL OR TIMESTAMP '{I.NOW}' < valid_until) AND (region IS NULL OR region = 'R1') AND claim_id IN (SELECT claim_id FROM sup))"""


def _eligible(spark, d, **how):
    return G.eligible_claims(I.claims(spark, d), I.refs(spark, d), I.sources(spark, d), I.decisions(spark, d), now(), region="R1", **how)


@query("j5_eligible_claims", _ELIG + " SELECT claim_id, classification, region FROM el")
def j5(spark, d):
    return _eligible(spark, d).select("claim_id", "classification", "region")


@query("j5_eligible_claims_filtered", _ELIG + " SELECT claim_id FROM el WHERE classification = 'official_rule' AND claim_id IN (SELECT claim_id FROM sup WHERE source_type = 'study' AND authority_class = 'community' AND published_at >= '2021' AND published_at <= '2023-12-31')")
def j5b(spark, d):
    return _eligible(spark, d, claim_type="official_rule", source_kind="study", authority="community", published_from="2021", published_until="2023-12-31").select("claim_id")


@query("j6_open_conflicts", _ELIG + f", {I.CONFLICTS}, x AS (SELECT DISTINCT conflict_id, unnest(claim_ids) AS claim_id FROM cf WHERE status = 'open') SELECT conflict_id, count(*) AS hits FROM x WHERE claim_id IN (SELECT claim_id FROM el) GROUP BY 1 HAVING count(*) >= 2")
def j6(spark, d):
    return G.open_conflicts(I.conflicts(spark, d), _eligible(spark, d))


@query("o5_selected_conflict_claims", _ELIG + f", {I.CONFLICTS} SELECT DISTINCT unnest(claim_ids) AS claim_id FROM cf WHERE status = 'open' INTERSECT SELECT claim_id FROM el")
def o5(spark, d):
    return I.conflicts(spark, d).where("status = 'open'").select(F.explode("claim_ids").alias("claim_id")).intersect(_eligible(spark, d).select("claim_id"))


@query(
    "l8_link_conflicts",
    f"""WITH {I.CLAIMS}, {I.CONFLICTS}, n AS (SELECT *, list_distinct(claim_ids) AS ids FROM cf)
SELECT conflict_id, CASE WHEN len(ids) < 2 OR relation = 'odd' THEN 'two_claims_and_relation_required' WHEN status = 'resolved' AND (resolution IS NULL OR reviewer_ref IS NULL) THEN 'resolution_required' WHEN EXISTS (SELECT 1 FROM (SELECT unnest(ids) AS i) WHERE i % 9 = 4) THEN 'unknown_claim' END AS error FROM n""",
)
def l8(spark, d):
    known = I.claims(spark, d).where("claim_id % 9 <> 4").withColumn("conflict_ids", F.array().cast("array<string>"))
    return G.link_conflicts(I.conflicts(spark, d), known)[0].select("conflict_id", "error")


@query(
    "l8_linked_claims",
    f"""WITH {I.CLAIMS}, {I.CONFLICTS}, n AS (SELECT *, list_distinct(claim_ids) AS ids FROM cf), g AS (SELECT conflict_id, unnest(ids) AS claim_id FROM n WHERE NOT (len(ids) < 2 OR relation = 'odd' OR (status = 'resolved' AND (resolution IS NULL OR reviewer_ref IS NULL))))
SELECT claim_id, coalesce(string_agg(conflict_id, '|' ORDER BY conflict_id), '') AS conflict_ids FROM cl LEFT JOIN g USING (claim_id) GROUP BY 1""",
)
def l8b(spark, d):
    c = I.claims(spark, d).withColumn("conflict_ids", F.array().cast("array<string>"))
    return G.link_conflicts(I.conflicts(spark, d), c)[1].select("claim_id", F.array_join("conflict_ids", "|").alias("conflict_ids"))


@query(
    "l7_normalize_claims",
    f"""WITH {I.CLAIMS}, {I.REFS}, n AS (SELECT claim_id, count(*) AS n, bool_or(source_id % 23 = 7) AS bad, bool_or(source_id % 31 = 9) AS times FROM rf GROUP BY 1)
SELECT claim_id, CASE WHEN claim_id % 12 = 5 THEN 'text_and_classification_required' WHEN coalesce(bad OR times, false) THEN 'evidence_invalid' WHEN claim_id % 5 = 2 AND claim_id % 10 <> 2 THEN 'reviewer_required' WHEN classification = 'official_rule' AND n IS NULL THEN 'official_rule_requires_evidence' END AS error, CAST(coalesce(n, 0) AS INTEGER) AS n_refs FROM cl LEFT JOIN n USING (claim_id)""",
)
def l7(spark, d):
    s = F.col("source_id")
    ref = F.struct(s.cast("string").alias("source_id"), F.coalesce("observed_revision", F.lit("rev")).alias("observed_revision"), "document_id", F.when(s % 23 == 7, "nohash").otherwise(F.sha2("document_id", 256)).alias("content_hash"), F.when(s % 31 == 9, "timestamp").otherwise("section").alias("locator_kind"), F.lit("00:20").alias("locator_value"), F.when(s % 31 == 9, "00:10").alias("locator_end"))
    r = I.refs(spark, d).groupBy("claim_id").agg(F.collect_list(ref).alias("evidence_refs"))
    k = F.col("claim_id")
    raw = I.claims(spark, d).join(r, "claim_id", "left").withColumns({"text": F.when(k % 12 != 5, F.col("text")), "review_status": F.when(k % 5 == 2, "reviewed"), "reviewer_ref": F.when(k % 10 == 2, "r")})
    old = raw.withColumns({"position": F.lit(0), "text": F.lit(None).cast("string")})
    return G.normalize_claims(raw.withColumn("position", F.lit(1)).unionByName(old)).select("claim_id", "error", "n_refs")


_EVID = (
    _ELIG
    + f""", {I.CORPUS}, {I.QUESTIONS}, {I.CONFLICTS}, {I.HITS},
eq AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'large ring' WHEN query_id % 3 = 1 THEN 'hot bolt' ELSE query END AS query FROM questions),
qw AS (SELECT DISTINCT query_id, unnest(regexp_extract_all({I.fold_sql('query')}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM eq), ew AS (SELECT DISTINCT claim_id, classification, unnest(regexp_extract_all({I.fold_sql('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM el),
m AS (SELECT query_id, claim_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE classification WHEN 'x' THEN 0 @PRIORITY@ ELSE 0 END DESC, claim_id) AS position FROM (SELECT DISTINCT query_id, claim_id, classification FROM qw JOIN ew USING (w))),
k AS (SELECT DISTINCT conflict_id, unnest(claim_ids) AS claim_id FROM cf WHERE status = 'open'), kq AS (SELECT DISTINCT query_id FROM (SELECT query_id, conflict_id FROM k JOIN m USING (claim_id) GROUP BY 1, 2 HAVING count(*) >= 2)),
hs AS (SELECT query_id, path AS source, CAST(regexp_extract(path, '(\\d+)\\.md$', 1) AS BIGINT) % 100 AS source_id, rank FROM hits), ok AS (SELECT * FROM hs WHERE source_id IN (SELECT source_id FROM de WHERE allowed AND purpose = 'internal_query')),
ei AS (SELECT query_id, 0 AS f, position AS r, 0 AS nth, rf.source_id || '|' || document_id AS item FROM m JOIN rf USING (claim_id) UNION ALL SELECT query_id, 1, rank, 0, source_id || '|' || source || '|section|' || source FROM ok UNION ALL SELECT query_id, 1, rank, 2, source_id || '|' || source || '|page|2' FROM ok),
e AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY o, item) AS position FROM (SELECT query_id, item, min((f * 1000000 + r) * 10 + nth) AS o FROM ei GROUP BY 1, 2))
SELECT query_id, 'claim' AS kind, CAST(position AS INTEGER) AS position, CAST(claim_id AS VARCHAR) AS item FROM m WHERE position <= 5 UNION ALL SELECT query_id, 'evidence', CAST(position AS INTEGER), item FROM e WHERE position <= 15
UNION ALL SELECT query_id, 'result', CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, source) AS INTEGER) AS position, source FROM ok QUALIFY position <= 5
UNION ALL SELECT query_id, 'outcome', 1, CASE WHEN query_id IN (SELECT query_id FROM kq) THEN 'conflicting' WHEN query_id IN (SELECT query_id FROM e UNION SELECT query_id FROM m) THEN 'supported' ELSE 'insufficient_evidence' END FROM eq"""
).replace("@PRIORITY@", " ".join(f"WHEN '{n}' THEN {v}" for n, v in G.PRIORITY.items()))


@query("r3_query_evidence", _EVID)
def r3(spark, d):
    q = I.questions(spark, d).withColumn("query", F.when(F.col("query_id") % 3 == 0, "large ring").when(F.col("query_id") % 3 == 1, "hot bolt").otherwise(F.col("query")))
    return G.query_evidence(q, _eligible(spark, d), I.refs(spark, d), I.conflicts(spark, d), _governed_hits(spark, d), I.decisions(spark, d))


def _governed_hits(spark, d):
    """Hits with four locators each, of which three count and one of these has no label; many of the sources may not be used."""
    at = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    locators = F.array(at("section", F.col("path")), at("page", F.lit(" ")), at("page", F.lit("2")), at("page", F.lit("3")))
    return I.hits(spark, d).select("query_id", F.col("path").alias("source"), (F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 100).alias("source_id"), "rank", locators.alias("locators"))


@query(
    "r3_evidence_outcome",
    _ELIG + f", {I.CORPUS}, {I.QUESTIONS}, {I.CONFLICTS}, {I.HITS}, q AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN ['large', 'ring'] WHEN query_id % 3 = 1 THEN ['hot', 'bolt'] ELSE ['qqq'] END AS ws FROM questions), m AS (SELECT DISTINCT query_id, claim_id FROM q, el WHERE list_has_any(ws, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))), x AS (SELECT DISTINCT conflict_id, unnest(claim_ids) AS claim_id FROM cf WHERE status = 'open'), c AS (SELECT DISTINCT query_id FROM (SELECT query_id, conflict_id FROM x JOIN m USING (claim_id) GROUP BY 1, 2 HAVING count(*) >= 2)), ok AS (SELECT query_id FROM hits WHERE query_id % 2 = 0 AND CAST(regexp_extract(path, '(\\d+)\\.md$', 1) AS BIGINT) % 100 IN (SELECT source_id FROM de WHERE allowed AND purpose = 'internal_query')) SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM c) THEN 'conflicting' WHEN query_id IN (SELECT query_id FROM m UNION SELECT query_id FROM ok) THEN 'supported' ELSE 'insufficient_evidence' END AS outcome FROM q",
)
def r3b(spark, d):
    """Every other query has hits: what is claimed nowhere is supported by a usable hit alone."""
    q = I.questions(spark, d).withColumn("query", F.when(F.col("query_id") % 3 == 0, "large ring").when(F.col("query_id") % 3 == 1, "hot bolt").otherwise("qqq"))
    found = G.query_evidence(q, _eligible(spark, d), I.refs(spark, d), I.conflicts(spark, d), _governed_hits(spark, d).where("query_id % 2 = 0"), I.decisions(spark, d))
    return found.where("kind = 'outcome'").select("query_id", F.col("item").alias("outcome"))


_BLOCK = f"""WITH {I.SOURCES}, dc AS (SELECT 's-' || source_id || '.md' AS path FROM src), b AS (SELECT 's-' || source_id || '.md' AS path, 'registry' AS r FROM src WHERE status = 'withdrawn' UNION SELECT 's-' || source_id || '.md', 'revocation' FROM src WHERE source_id % 8 = 3 UNION SELECT 's-' || source_id || '.md', 'source_revoked' FROM src WHERE revoked UNION SELECT 's-' || source_id || '.md', 'tombstone' FROM src WHERE source_id % 9 = 6)"""


def _blocked(spark, d):
    s = I.sources(spark, d).withColumn("source_id", F.col("source_id").cast("string"))
    docs = s.select(F.concat(F.lit("s-"), "source_id", F.lit(".md")).alias("path"))
    rev = s.where("CAST(source_id AS long) % 8 = 3").select(F.lit(None).cast("string").alias("source_id"), "canonical", F.lit(None).cast("boolean").alias("revoked"))
    tomb = s.where("CAST(source_id AS long) % 9 = 6").select(F.concat(F.lit("./rag/documents/s-"), "source_id", F.lit(".md")).alias("path"))
    return G.blocked_documents(docs, s, s.select("source_id", "canonical", "status"), rev, tomb)


@query("j7_blocked_documents", _BLOCK + " SELECT path, string_agg(r, '|' ORDER BY r) AS reasons FROM b GROUP BY 1")
def j7(spark, d):
    return _blocked(spark, d).withColumn("reasons", F.array_join("reasons", "|"))


@query("j8_filter_revoked_hits", _BLOCK + ", h AS (SELECT l_orderkey AS query_id, 's-' || l_suppkey || '.md' AS path FROM lineitem) SELECT query_id, count(*) AS hits FROM h WHERE path NOT IN (SELECT path FROM b) GROUP BY 1")
def j8(spark, d):
    h = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("s-"), F.col("l_suppkey").cast("string"), F.lit(".md")).alias("path"))
    return G.filter_revoked_hits(h, _blocked(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


@query("j9_revoke_sources", f"WITH {I.SOURCES}, {I.REFS} SELECT s.source_id, destination AS destinations, (SELECT count(DISTINCT claim_id) FROM rf WHERE rf.source_id = s.source_id) AS claims FROM src s WHERE s.source_id % 10 = 3")
def j9(spark, d):
    s = I.sources(spark, d)
    return G.revoke_sources(s.where("source_id % 10 = 3"), s, I.refs(spark, d)).select("source_id", F.array_join("destinations", "|").alias("destinations"), F.size("claims").cast("long").alias("claims"))


@query(
    "j12_derivative_check",
    _ELIG + """, le AS (SELECT CASE WHEN c_custkey % 20 = 3 THEN 'lesson-1' ELSE 'lesson-' || c_custkey END AS lesson_id, c_custkey AS k, CASE WHEN c_custkey % 9 <> 2 THEN c_name END AS content, CASE WHEN c_custkey % 8 = 5 THEN [] WHEN c_custkey % 8 = 6 THEN ['course-7-proof', 'nowhere'] ELSE [CAST(c_custkey AS VARCHAR), CAST(c_custkey * 3 AS VARCHAR)] END AS refs FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY k) AS n FROM le), r AS (SELECT lesson_id, unnest(refs) AS ref FROM n WHERE n = 1), kn AS (SELECT CAST(claim_id AS VARCHAR) AS claim_id FROM cl), ok AS (SELECT CAST(claim_id AS VARCHAR) AS claim_id FROM el)
SELECT lesson_id, 'duplicate_or_missing_lesson_id' AS code FROM n WHERE n > 1 UNION ALL SELECT lesson_id, 'lesson_missing_objective_or_content' FROM n WHERE n = 1 AND content IS NULL UNION ALL SELECT lesson_id, 'lesson_missing_evidence' FROM n WHERE n = 1 AND len(refs) = 0
UNION ALL SELECT lesson_id, CASE WHEN ref IN (SELECT claim_id FROM kn) THEN 'ineligible_lesson_evidence' WHEN contains(ref, 'course-7') THEN 'self_referential_proof' ELSE 'unknown_lesson_evidence_reference' END FROM r WHERE ref NOT IN (SELECT claim_id FROM ok)""",
)
def j12(spark, d):
    k = F.col("c_custkey")
    refs = F.when(k % 8 == 5, F.array().cast("array<string>")).when(k % 8 == 6, F.array(F.lit("course-7-proof"), F.lit("nowhere"))).otherwise(F.array(k.cast("string"), (k * 3).cast("string")))
    le = I.table(spark, d, "customer").select(F.lit("course-7").alias("course_id"), F.when(k % 20 == 3, "lesson-1").otherwise(F.concat(F.lit("lesson-"), k.cast("string"))).alias("lesson_id"), k.alias("position"), F.when(k % 9 != 2, F.col("c_name")).alias("content"), refs.alias("refs"))
    text = lambda df: df.select(F.col("claim_id").cast("string").alias("claim_id"))
    return G.derivative_check(le, text(I.claims(spark, d)), text(_eligible(spark, d)))


@query("j14_version_divergence", "SELECT s_suppkey AS package_id, CASE WHEN s_suppkey % 5 = 0 THEN 'divergence_inputs_missing' WHEN s_suppkey % 3 = 0 THEN 'synchronized' WHEN s_suppkey % 4 = 1 THEN 'skill_version_missing' WHEN s_suppkey % 4 = 2 THEN 'skill_rag_divergence' ELSE 'synchronized' END AS code FROM supplier")
def j14(spark, d):
    k = F.col("s_suppkey")
    s = I.table(spark, d, "supplier")
    skills = s.where(k % 5 != 0).select(k.alias("package_id"), F.concat(F.lit("# Skill\n"), F.when(k % 4 == 1, "no version").when(k % 4 == 2, "- Version: `2.0`").otherwise("- Version: `1.0`"), F.lit("\nmore")).alias("text"))
    return G.version_divergence(s.select(k.alias("package_id"), F.when(k % 3 != 0, "1.0").alias("version")), skills)


# --- graphs ---------------------------------------------------------------------------------------------------------


def _edges(spark, d):
    l = I.table(spark, d, "lineitem")
    a = l.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"))
    k = F.col("s_suppkey")
    b = I.table(spark, d, "supplier").where(k % 7 != 0).select(F.concat(F.lit("s"), k.cast("string")).alias("source"), F.concat(F.lit("s"), F.floor(k / 2).cast("string")).alias("target"))
    return a.unionByName(b).where("source <> target")


_EDGES = "ed AS (SELECT DISTINCT * FROM (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey // 2) FROM supplier WHERE s_suppkey % 7 <> 0) WHERE source <> target)"


@query("g1_impact_closure", f"WITH RECURSIVE {_EDGES}, r(node) AS (SELECT 's3' UNION SELECT source FROM r JOIN ed ON ed.target = r.node) SELECT node FROM r")
def g1(spark, d):
    return graph.impact_closure(_edges(spark, d), spark.createDataFrame([("s3",)], "node string")).select("node")


@query("g2_graph_faults", "SELECT 'unknown_node' AS code, 's' || s_suppkey AS id FROM supplier WHERE s_suppkey % 9 = 4 UNION ALL SELECT 'duplicate_node', 's' || s_suppkey FROM supplier WHERE s_suppkey % 9 = 5 UNION ALL SELECT 'invalid_relation', 's' || s_suppkey || '->n' || s_nationkey FROM supplier WHERE s_suppkey % 9 = 6 UNION ALL SELECT DISTINCT 'unknown_node', 'n' || s_nationkey FROM supplier WHERE s_nationkey % 4 = 1")
def g2(spark, d):
    s, k = I.table(spark, d, "supplier"), F.col("s_suppkey")
    sid, nid = F.concat(F.lit("s"), k.cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    nodes = s.where(k % 9 != 4).select(sid.alias("id")).unionByName(s.where(k % 9 == 5).select(sid.alias("id"))).unionByName(s.where("s_nationkey % 4 <> 1").select(nid.alias("id")).distinct())
    return graph.graph_faults(nodes, s.select(sid.alias("source"), nid.alias("target"), F.when(k % 9 == 6, "likes").otherwise("supports").alias("relation")))


@query(
    "g2_dependency_cycles",
    "SELECT 'n' || n_nationkey AS node, 'n0' AS component FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'a', 'a' UNION ALL SELECT 'b', 'a'",
)
def g2b(spark, d):
    k = F.col("n_nationkey")
    n = I.table(spark, d, "nation")
    ring = n.where("n_nationkey < 5").select(F.concat(F.lit("n"), k.cast("string")).alias("source"), F.concat(F.lit("n"), ((k + 1) % 5).cast("string")).alias("target"))
    tails = n.where("n_nationkey >= 5").select(F.concat(F.lit("n"), k.cast("string")).alias("source"), F.concat(F.lit("n"), (k - 5).cast("string")).alias("target"))
    two = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "end")], "source string, target string")
    return graph.dependency_cycles(ring.unionByName(tails).unionByName(two).unionByName(_edges(spark, d)))


@query(
    "g3_link_frontier",
    """WITH RECURSIVE pg AS (SELECT 'https://site.example.org/' || page_id AS url, page_id AS k FROM pages), ln AS (SELECT k, unnest([0, 1, 2]) AS pos, 'https://site.example.org/' || unnest([k * 2 + 1, k * 2 + 2, k * 3]) AS target FROM pg), l2 AS (SELECT 'https://site.example.org/' || k AS source, pos, target FROM ln),
q AS (SELECT 0 AS depth, 'https://site.example.org/0' AS url UNION ALL SELECT q.depth + 1, l2.target FROM q JOIN pg ON pg.url = q.url JOIN l2 ON l2.source = q.url WHERE q.depth < 4)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM q WHERE url IN (SELECT url FROM pg) GROUP BY 1""",
)
def g3(spark, d):
    k = F.col("page_id")
    at = lambda c: F.concat(F.lit("https://site.example.org/"), c.cast("string"))
    p = I.table(spark, d, "pages").select("page_id", at(k).alias("url"))
    links = p.select(F.col("url").alias("source"), F.posexplode(F.array(at(k * 2 + 1), at(k * 2 + 2), at(k * 3), F.lit("https://other.example.org/x"))).alias("position", "target"))
    seeds = spark.createDataFrame([("https://site.example.org/0", 0)], "url string, seq long")
    return graph.link_frontier(p.select("url"), links, seeds, "site.example.org", max_depth=4, max_pages=10_000).select("url", "depth")


@query(
    "g4_change_impact",
    f"""WITH RECURSIVE {_EDGES}, op AS (SELECT c_custkey % 25 AS change_id, ['source_update', 'course_edit', 'page_edit', 'policy_change', 'odd', 'decision_correct'][c_custkey % 6 + 1] AS type, 's' || (c_custkey % 40) AS target FROM customer WHERE c_custkey % 25 <> 3 UNION ALL SELECT 3, 'page_edit', 's2' UNION ALL SELECT 3, 'course_edit', 's2'),
r(change_id, node) AS (SELECT DISTINCT change_id, target FROM op UNION SELECT r.change_id, ed.source FROM r JOIN ed ON ed.target = r.node), n AS (SELECT change_id, count(*) AS affected FROM r GROUP BY 1),
g AS (SELECT change_id, list_distinct(list(type)) AS ts, list_distinct(list(CASE WHEN starts_with(type, 'source_') OR type = 'decision_correct' THEN 'factual' WHEN type IN ('course_edit', 'page_edit') THEN 'editorial' WHEN type = 'policy_change' THEN 'mixed' ELSE 'unknown' END)) AS ks, count(DISTINCT target) AS targets FROM op GROUP BY 1)
SELECT change_id, CASE WHEN len(ks) > 1 OR list_contains(ks, 'mixed') THEN 'mixed' ELSE ks[1] END AS classification, array_to_string(list_sort(list_concat(['contract', 'dependency_graph'], CASE WHEN list_contains(ts, 'source_update') THEN ['rights', 'privacy', 'retrieval', 'revocation'] ELSE [] END, CASE WHEN list_has_any(ts, ['course_edit', 'page_edit']) THEN ['derivatives', 'golden', 'editorial_review'] ELSE [] END, CASE WHEN list_contains(ts, 'page_edit') THEN ['commercial_decision'] ELSE [] END)), '|') AS checks, targets, affected, CASE WHEN change_id % 4 = 1 THEN 'DEPENDENCY_UNKNOWN' ELSE '' END AS blockers, change_id % 4 = 1 AS unknown_dependencies FROM g JOIN n USING (change_id)""",
)
def g4(spark, d):
    op = _operations(spark, d)
    unknown = op.where("change_id % 4 = 1").select("change_id")
    return graph.change_impact(op, _edges(spark, d), unknown).withColumns({c: F.array_join(c, "|") for c in ("checks", "blockers")})


@query(
    "g4_affected_nodes",
    f"""WITH RECURSIVE {_EDGES}, op AS (SELECT c_custkey % 25 AS change_id, 's' || (c_custkey % 40) AS target FROM customer WHERE c_custkey % 25 <> 3 UNION ALL SELECT 3, 's2'),
r(change_id, node) AS (SELECT DISTINCT change_id, target FROM op UNION SELECT r.change_id, ed.source FROM r JOIN ed ON ed.target = r.node) SELECT * FROM r""",
)
def g4_nodes(spark, d):
    return graph.affected_nodes(_operations(spark, d), _edges(spark, d))


def _operations(spark, d):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("source_update", "course_edit", "page_edit", "policy_change", "odd", "decision_correct"))), (k % 6 + 1).cast("int"))
    op = I.table(spark, d, "customer").where(k % 25 != 3).select((k % 25).alias("change_id"), kind.alias("type"), F.concat(F.lit("s"), (k % 40).cast("string")).alias("target_id"))
    return op.unionByName(spark.createDataFrame([(3, "page_edit", "s2"), (3, "course_edit", "s2")], "change_id long, type string, target_id string"))


@query("o3_union_documents", f"WITH {I.CORPUS} SELECT kind, count(*) AS documents FROM (SELECT 'acquired' AS kind FROM corpus UNION ALL SELECT 'learned' FROM conversations WHERE role = 'user') GROUP BY 1")
def o3(spark, d):
    a = I.corpus(spark, d).select(F.lit("acquired").alias("kind"), "path")
    b = I.table(spark, d, "conversations").where("role = 'user'").select(F.lit("learned").alias("kind"), F.col("conv_id"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))
