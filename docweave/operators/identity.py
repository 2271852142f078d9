"""Identity of sources and documents: first-wins selection, differences between snapshots, corpus hashes, reuse plans, revisions.

Joins carry keys and hashes, never contents, so the widest shuffle is a few hundred bytes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import records as R
from .graph import Spool


def _keyed(records: DataFrame) -> DataFrame:
    return records.withColumns({
        "logical_key": R.logical_key(F.col("canonical"), F.col("version")),
        "identity": R.content_identity(F.col("canonical"), F.col("version"), F.col("content_hash")),
    })


def dedupe_records(records: DataFrame, keys: tuple = ("package_id", "logical_key")) -> DataFrame:
    """One record a package and logical key: that with the smallest destination (ties: smallest content hash). An aggregate, so duplicates are reduced before the shuffle."""
    keyed = records if "logical_key" in records.columns else _keyed(records)
    rest = [c for c in keyed.columns if c not in (*keys, "destination")]
    best = F.min(F.struct("destination", *sorted(rest, key=lambda c: c != "content_hash"))).alias("_best")
    return keyed.groupBy(*keys).agg(best).select(*keys, "_best.*")


def state_diff(previous: DataFrame, current: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """package_id, logical_key, action (added, updated, removed), old and new destination. Unchanged records are left out.

    Both sides are (package_id, canonical, version, content_hash, destination). Packages in ``failed`` (package_id), whose acquisition had an error, and packages without any current
    record give no rows: an incomplete look never removes anything.
    """
    p, c = dedupe_records(_keyed(previous)), dedupe_records(_keyed(current))
    seen = c.select("package_id").distinct()
    p = p.join(seen, "package_id", "left_semi")
    if failed is not None:
        p, c = (x.join(failed.select("package_id").distinct(), "package_id", "left_anti") for x in (p, c))
    old = p.select("package_id", "logical_key", F.col("identity").alias("old_identity"), F.col("destination").alias("old_destination"))
    new = c.select("package_id", "logical_key", F.col("identity").alias("new_identity"), F.col("destination").alias("new_destination"))
    both = old.join(new, ["package_id", "logical_key"], "full_outer")
    action = (
        F.when(F.col("old_identity").isNull(), "added").when(F.col("new_identity").isNull(), "removed")
        .when((F.col("old_identity") != F.col("new_identity")) | (F.col("old_destination") != F.col("new_destination")), "updated")
    )
    return both.select("package_id", "logical_key", action.alias("action"), "old_destination", "new_destination").where("action IS NOT NULL")


def file_diff(previous: DataFrame, current: DataFrame, keys: tuple = ("package_id", "path"), changed: str = "update") -> DataFrame:
    """Keys and action (add, update, remove) of (keys, sha256) tables; unchanged files are left out."""
    old, new = previous.select(*keys, F.col("sha256").alias("_old")), current.select(*keys, F.col("sha256").alias("_new"))
    action = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").when(F.col("_old") != F.col("_new"), changed)
    return old.join(new, list(keys), "full_outer").select(*keys, action.alias("action")).where("action IS NOT NULL")


def artifact_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """package_id, code, artifacts (sorted paths) of packages whose generated files are not as recorded."""
    changed = file_diff(recorded, current)
    return changed.groupBy("package_id").agg(F.array_sort(F.collect_set("path")).alias("artifacts")).select("package_id", F.lit("skill_update_requires_review").alias("code"), "artifacts")


def dedupe_canonical(entries: DataFrame) -> DataFrame:
    """Entries (package_id, seq, canonical, status): among accepted ones of a canonical URL the first in order of seq stays, the others become ignored, reason duplicate-canonical."""
    accepted = F.col("status") == "accepted"
    nth = F.row_number().over(Window.partitionBy("package_id", "canonical", accepted).orderBy("seq"))
    later = accepted & (nth > 1)
    return entries.withColumn("_later", later).withColumns({"reason": F.when(F.col("_later"), "duplicate-canonical"), "status": F.when(F.col("_later"), "ignored").otherwise(F.col("status"))}).drop("_later")


#: A name that was made for a later source: ten hexadecimal figures of a hash, and a number from 2 on.
_MADE = r"^(.+?)--([0-9a-f]{10})(?:-[0-9]+)?((?:--[0-9a-f]{10}(?:-[0-9]+)?)*)$"


def unique_destinations(entries: DataFrame) -> DataFrame:
    """Entries (package_id, seq, destination, source) with final_destination, no name twice in a package: in order of seq, the first to want a name gets it; others get the name without its folder and ten characters of the hash of
    their source, then -2, -3, ..., whatever is free. Null sources count as empty, a package's seq are distinct.

    Made names can only meet made names of the same stem and hash, and names that are wanted and look as if they were made. Where no such name is wanted the nth of a stem and hash has number n. The others are settled
    in order, by stem and hash: few rows each, unless one source wants one name again and again; then each still takes a step, as numbers are searched on from the last.
    """
    first = F.row_number().over(Window.partitionBy("package_id", "destination").orderBy("seq")) == 1
    e = entries.withColumns({"_first": first, "_digest": F.substring(F.sha2(F.coalesce("source", F.lit("")), 256), 1, 10)})
    name = F.regexp_extract("destination", r"([^/]*)$", 1)
    e = e.withColumns({"_stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_extension": F.regexp_extract(name, r".(\.[^.]*)$", 1)})
    e = e.withColumn("_stem", F.when(F.col("_stem") == "", "source").otherwise(F.col("_stem")))
    looks = ~F.contains("destination", F.lit("/")) & F.regexp_like("_stem", F.lit(_MADE))
    made = F.concat("_stem", F.lit("--"), "_digest")
    e = e.withColumns({"_looks": looks, "_made": made}).withColumn("_asks", ~F.col("_first") | F.col("_looks"))
    of = F.when(~F.col("_first"), F.col("_made")).otherwise(F.col("_stem"))
    e = e.withColumns({"_root": F.regexp_extract(of, _MADE, 1), "_hash": F.regexp_extract(of, _MADE, 2)})
    group = ["package_id", "_root", "_hash", "_extension"]
    family = Window.partitionBy(*group)
    asking = e.where("_asks").withColumn("_hard", F.max(F.col("_looks").cast("int")).over(family) == 1)
    # no wanted name looks like a made one: numbers
    again = F.row_number().over(Window.partitionBy(*group, "_made").orderBy("seq"))
    plain = asking.where("NOT _hard").withColumn("final_destination", F.concat("_made", F.when(again > 1, F.concat(F.lit("-"), again.cast("string"))).otherwise(""), "_extension"))

    def settle(batches):
        now, used, numbers = None, set(), {}
        for b in batches:
            out = []
            for *key, wanted, stem, extension, looks in zip(*(b[c] for c in group), b["destination"], b["_made"], b["_extension"], b["_looks"]):
                if key != now:
                    now, used, numbers = key, set(), {}
                # a wanted name with a folder, or one that does not look made, can only be taken by the first to want it, who is not here
                own = wanted if looks and wanted not in used else f"{stem}{extension}"
                if own in used:
                    n = numbers.get(stem, 2)  # names are never given back, so what was taken below stays taken
                    while (own := f"{stem}-{n}{extension}") in used:
                        n += 1
                    numbers[stem] = n + 1
                used.add(own)
                out.append(own)
            yield b.assign(final_destination=out)

    hard = asking.where("_hard").repartition(*group).sortWithinPartitions(*group, "seq")
    hard = hard.mapInPandas(settle, StructType([*hard.schema.fields, StructField("final_destination", StringType())]))
    kept = e.where("NOT _asks").withColumn("final_destination", F.col("destination"))
    columns = [*entries.columns, "final_destination"]
    return kept.select(*columns).unionByName(plain.select(*columns)).unionByName(hard.select(*columns))


def snapshot_documents(docs: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """package_id, path, sha256, size of (package_id, path, content). Packages that hold a blocked document (package_id, path) have no snapshot."""
    rows = docs.select("package_id", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size"))
    if blocked is not None:
        refused = rows.join(blocked, ["package_id", "path"], "left_semi").select("package_id").distinct()
        rows = rows.join(refused, "package_id", "left_anti")
    return rows


def corpus_hash(snapshot: DataFrame) -> DataFrame:
    """package_id, documents, bytes, corpus_hash: a hash over the sorted (path, sha256) pairs of each package.

    The order matters, so a package's pairs meet in one row: about 130 bytes a document, good for some million documents a package. ``tree_hash`` bounds larger ones.
    """
    pairs = F.array_sort(F.collect_list(F.array("path", "sha256")))
    return snapshot.groupBy("package_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("bytes"), F.sha2(F.to_json(pairs), 256).alias("corpus_hash"))


def tree_hash(snapshot: DataFrame, width: int = 2) -> DataFrame:
    """package_id, tree_hash: as corpus_hash in two levels, buckets by the beginning of the path's hash first. Another value, but no group beyond a 16**width-th of a package."""
    bucket = F.substring(F.sha2("path", 256), 1, width)
    level = snapshot.groupBy("package_id", bucket.alias("bucket")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.array("path", "sha256")))), 256).alias("hash"))
    return level.groupBy("package_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.array("bucket", "hash")))), 256).alias("tree_hash"))


#: Hexadecimal figures of a path's hash that name its bucket in the tree of a package, and so its depth.
TREE_DEPTH = 4


def _bucket_hash(rows: DataFrame, depth: int) -> DataFrame:
    """package_id, node, hash of the buckets of (package_id, path, sha256)."""
    node = F.substring(F.sha2("path", 256), 1, depth)
    return rows.groupBy("package_id", node.alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "sha256"))), "\n"), 256).alias("hash"))


def _above(nodes: DataFrame) -> DataFrame:
    """package_id, node, hash of the parents of nodes (at most 16 children each)."""
    up = F.substring("node", 1, F.length("node") - 1)
    return nodes.groupBy("package_id", up.alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("node", F.lit(":"), "hash"))), "\n"), 256).alias("hash"))


def hash_tree(snapshot: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """package_id, node, hash: the Merkle tree of each package's (path, sha256). Nodes are beginnings of the paths' hashes, buckets have ``depth`` figures, the root none; an empty package has no tree."""
    tree = Spool(snapshot.sparkSession, "tree")
    level = tree.add(_bucket_hash(snapshot, depth))
    for _ in range(depth):
        level = tree.add(_above(level))
    return tree.all()


def refresh_tree(tree: DataFrame, snapshot: DataFrame, changed: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """package_id, node, hash (null: the node goes) of the nodes on the ways from changed paths (package_id, path: added, removed or altered) to their roots; all others of ``tree`` stay as they are.

    k changes touch k buckets and k nodes a level at most, and read their siblings; ``snapshot`` is the packages as they are now, of which the changed buckets alone are hashed.
    """
    node = F.substring(F.sha2("path", 256), 1, depth)
    ways = changed.select("package_id", node.alias("node")).distinct()
    own = snapshot.withColumn("node", node).join(ways, ["package_id", "node"], "left_semi")
    touched = Spool(tree.sparkSession, "touched")
    level = touched.add(ways.join(_bucket_hash(own, depth), ["package_id", "node"], "left"))
    for n in range(depth, 0, -1):
        up = level.select("package_id", F.substring("node", 1, n - 1).alias("up")).distinct()
        old = tree.where(F.length("node") == n).withColumn("up", F.substring("node", 1, n - 1)).join(up, ["package_id", "up"], "left_semi")
        children = old.join(level.select("package_id", "node"), ["package_id", "node"], "left_anti").select("package_id", "node", "hash").unionByName(level.where("hash IS NOT NULL"))
        level = touched.add(up.select("package_id", F.col("up").alias("node")).join(_above(children), ["package_id", "node"], "left"))
    return touched.all()


def apply_refresh(tree: DataFrame, touched: DataFrame) -> DataFrame:
    """The tree with its touched nodes."""
    return tree.join(touched.select("package_id", "node"), ["package_id", "node"], "left_anti").unionByName(touched.where("hash IS NOT NULL"))


def membership_proofs(tree: DataFrame, snapshot: DataFrame, asked: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """package_id, path, proof, root of asked paths (package_id, path) that the snapshot holds: the entries of the path's bucket, then by level the children of the node above, each as ``name:hash``; hashing them level by level leads to the root."""
    node = F.substring(F.sha2("path", 256), 1, depth)
    held = snapshot.join(asked.select("package_id", "path").distinct(), ["package_id", "path"], "left_semi").select("package_id", "path", node.alias("bucket"))
    entries = snapshot.withColumn("bucket", node).join(held.select("package_id", "bucket").distinct(), ["package_id", "bucket"], "left_semi")
    entries = entries.groupBy("package_id", "bucket").agg(F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "sha256"))).alias("e"))
    levels = tree.where("node <> ''").groupBy("package_id", F.substring("node", 1, F.length("node") - 1).alias("up")).agg(F.array_sort(F.collect_list(F.concat("node", F.lit(":"), "hash"))).alias("children"))
    ups = held.select("package_id", "path", "bucket", F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda n: F.substring("bucket", F.lit(1), n))).alias("up"))
    ways = ups.join(levels, ["package_id", "up"]).groupBy("package_id", "path", "bucket").agg(F.array_sort(F.collect_list(F.struct((-F.length("up")).alias("n"), "children"))).alias("ways"))
    root = tree.where("node = ''").select("package_id", F.col("hash").alias("root"))
    return ways.join(entries, ["package_id", "bucket"]).join(root, "package_id").select("package_id", "path", F.concat(F.array("e"), F.col("ways.children")).alias("proof"), "root")


def snapshot_ids(snapshot: DataFrame, headers: DataFrame) -> DataFrame:
    """package_id, snapshot_id: one hash over a package's corpus hash and all header fields (headers: one row a package). A package with a header but without documents has the hash of an empty corpus."""
    h = headers.join(corpus_hash(snapshot).select("package_id", F.col("corpus_hash").alias("_corpus")), "package_id", "left")
    fields = {"corpus_hash": F.coalesce("_corpus", F.sha2(F.lit("[]"), 256))} | {c: F.col(c) for c in headers.columns if c != "package_id"}
    return h.select("package_id", R.canonical_hash(fields).alias("snapshot_id"))


def validate_snapshot(pinned: DataFrame, current: DataFrame, active: DataFrame) -> DataFrame:
    """package_id, code of pinned snapshots (package_id, snapshot_id, revocation_hash): rag_snapshot_incompatible where the package as it is (package_id, snapshot_id) has another identity or is gone,
    else rag_snapshot_revoked where the revocations in force (package_id, revocation_hash) are others, else null: the snapshot may be served."""
    p = pinned.join(current.select("package_id", F.col("snapshot_id").alias("_id")), "package_id", "left").join(active.select("package_id", F.col("revocation_hash").alias("_rev")), "package_id", "left")
    code = F.when(F.col("_id").isNull() | ~F.col("_id").eqNullSafe(F.col("snapshot_id")), "rag_snapshot_incompatible").when(~F.col("_rev").eqNullSafe(F.col("revocation_hash")), "rag_snapshot_revoked")
    return p.select("package_id", code.alias("code"))


def package_revisions(layers: DataFrame) -> DataFrame:
    """package_id, the six layer revisions, composition_hash, release_id from (package_id, layer, revision). A missing policy is default-policy-v1, other missing layers are ``unknown``."""
    names = ["corpus", "index", "skill", "router", "policy", "golden"]
    p = layers.groupBy("package_id").agg(*[F.max(F.when(F.col("layer") == n, F.col("revision"))).alias(f"{n}_revision") for n in names])
    p = p.withColumns({f"{n}_revision": F.coalesce(f"{n}_revision", F.lit("default-policy-v1" if n == "policy" else "unknown")) for n in names})
    p = p.withColumn("composition_hash", R.canonical_hash({f"{n}_revision": F.col(f"{n}_revision") for n in names}))
    return p.withColumn("release_id", F.concat(F.lit("release-"), F.substring("composition_hash", 1, 24)))


def revision_evidence(recorded: DataFrame, layers: DataFrame) -> DataFrame:
    """package_id, status of recorded revisions (the columns of package_revisions) against layers as they are: incomplete (a recorded field is null or empty), invalidated (one differs), valid.

    The golden set is no part of the package: its recorded revision enters the current composition as it is. A package without layers has their defaults.
    """
    golden = recorded.select("package_id", F.lit("golden").alias("layer"), F.col("golden_revision").alias("revision"))
    current = package_revisions(layers.where("layer <> 'golden'").join(recorded.select("package_id"), "package_id", "left_semi").unionByName(golden))
    fields = [c for c in current.columns if c != "package_id"]
    r = recorded.join(current.select("package_id", *[F.col(c).alias(f"_{c}") for c in fields]), "package_id", "left")
    some = lambda fits: F.exists(F.array(*[fits(c) for c in fields]), lambda x: x)
    status = F.when(some(lambda c: F.coalesce(F.col(c), F.lit("")) == ""), "incomplete").when(some(lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))), "invalidated").otherwise("valid")
    return r.select("package_id", status.alias("status"))


#: What is compared before documents may be reused, in this order, and the reason if it differs.
REUSE_ORDER = (
    ("embedding", "embedding_changed"), ("model", "model_changed"), ("configuration", "configuration_changed"), ("artifacts", "artifacts_changed"), ("revocation", "revocation_changed"),
    ("backend_snapshot", "backend_snapshot_changed"), ("backend_name", "backend_changed"), ("backend_version", "backend_version_changed"),
)


def plan_reuse(previous: DataFrame, current: DataFrame, previous_headers: DataFrame, headers: DataFrame) -> DataFrame:
    """package_id, mode, reason and counts of reused, changed and removed documents.

    Documents are (package_id, path, sha256); headers have one row a package with the fields of REUSE_ORDER and supports_incremental. Without a previous header all is changed.
    """
    old, new = previous.select("package_id", "path", F.col("sha256").alias("_old")), current.select("package_id", "path", F.col("sha256").alias("_new"))
    old = old.join(previous_headers.select("package_id"), "package_id", "left_semi")
    n = old.join(new, ["package_id", "path"], "full_outer").groupBy("package_id").agg(
        F.count_if(F.col("_old") == F.col("_new")).alias("unchanged"),
        F.count_if(F.col("_new").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"),
        F.count_if(F.col("_new").isNull()).alias("removed"),
    )
    fields = [f for f, _ in REUSE_ORDER]
    h = headers.join(previous_headers.select("package_id", F.lit(True).alias("_had"), *[F.col(f).alias(f"_{f}") for f in fields]), "package_id", "left")
    reason = F.when(F.col("_had").isNull(), "no_previous_snapshot")
    for f, code in REUSE_ORDER:
        reason = reason.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), code)
    reason = reason.when(~F.coalesce("supports_incremental", F.lit(False)), "backend_incremental_unsupported").otherwise("incremental_reuse")
    h = h.select("package_id", reason.alias("reason")).join(n, "package_id", "left")
    incremental = F.col("reason") == "incremental_reuse"
    zero = lambda c: F.coalesce(c, F.lit(0))
    return h.select("package_id", F.when(incremental, "incremental").otherwise("full_rebuild").alias("mode"), "reason", F.when(incremental, zero(F.col("unchanged"))).otherwise(F.lit(0)).alias("reused"), zero(F.col("changed")).alias("changed"), zero(F.col("removed")).alias("removed"))


def manifest_rollup(entries: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """package_id, counts by status, and the status of the whole: blocked (a decision is needed and nothing selected), partial (errors or quarantine), succeeded."""
    n = entries.groupBy("package_id").agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "ignored").alias("ignored"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"), F.count_if(F.col("status").isin("error", "failed")).alias("errors"),
    )
    blocked = F.lit(False)
    if decisions is not None:
        n = n.join(decisions.select("package_id", "requires_decision", "selected"), "package_id", "left")
        blocked = F.coalesce(F.col("requires_decision") & ~F.coalesce("selected", F.lit(False)), F.lit(False))
    status = F.when(blocked, "blocked").when((F.col("errors") > 0) | (F.col("quarantined") > 0), "partial").otherwise("succeeded")
    return n.select("package_id", "accepted", "ignored", "quarantined", "errors", status.alias("status"))


def manifest_integrity(entries: DataFrame, documents: DataFrame, index: DataFrame) -> DataFrame:
    """package_id, code of every fault: duplicate accepted (canonical, version), accepted entries against files, index metrics against files, metrics out of range."""
    accepted = entries.where("status = 'accepted'")
    twice = accepted.groupBy("package_id", "canonical", F.coalesce("version", F.lit("")).alias("v")).count().where("count > 1").select("package_id").distinct().select("package_id", F.lit("duplicate_source").alias("code"))
    files = documents.groupBy("package_id").agg(F.count(F.lit(1)).alias("files"))
    n = accepted.groupBy("package_id").agg(F.count(F.lit(1)).alias("accepted"))
    i = index.join(files, "package_id", "left").join(n, "package_id", "left").withColumns({"files": F.coalesce("files", F.lit(0)), "accepted": F.coalesce("accepted", F.lit(0))})
    faults = [
        (F.col("files") < 1, "empty_rag"),
        ((F.col("accepted") > 0) & (F.col("files") != F.col("accepted")), "manifest_document_count"),
        (~F.col("corpus_documents").eqNullSafe(F.col("files")), "rag_document_count"),
        (F.coalesce("corpus_documents", F.lit(0)) < 1, "rag_document_count_invalid"),
        (F.coalesce("operator_chunks", F.lit(0)) < 1, "rag_operator_chunks_invalid"),
        (F.coalesce(F.col("backend_total_documents") < 0, F.lit(False)) | F.coalesce(F.col("backend_total_chunks") < 0, F.lit(False)), "rag_backend_metric_invalid"),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in faults]))
    return i.select("package_id", F.explode(codes).alias("code")).unionByName(twice)


#: States of a package from least to most ready.
READINESS = ("not-ready", "scaffold-ready", "skill-enriched", "corpus-ready", "indexed", "evaluated", "release-ready")


def readiness(packages: DataFrame) -> DataFrame:
    """package_id, state, claim (ok, over_claim, stale) of evidence flags (scaffold, enriched, corpus_ready, indexed, evaluation_ok, evaluation_valid, backend_evidence, release_validated) and a declared state."""
    on = lambda c: F.coalesce(c, F.lit(False))
    enriched = on("enriched") & on("scaffold")
    evaluated = on("evaluation_ok") & on("evaluation_valid")
    state = (
        F.when(on("release_validated") & evaluated & on("backend_evidence") & enriched, "release-ready").when(evaluated, "evaluated").when(on("corpus_ready") & on("indexed"), "indexed")
        .when(on("corpus_ready"), "corpus-ready").when(enriched, "skill-enriched").when(on("scaffold"), "scaffold-ready").otherwise("not-ready")
    )
    rank = lambda c: F.array_position(F.array(*map(F.lit, READINESS)), c)
    r = packages.withColumn("state", state)
    claim = F.when(F.col("declared").isNull() | (F.col("declared") == F.col("state")), "ok").when(rank(F.col("declared")) > rank(F.col("state")), "over_claim").otherwise("stale")
    return r.select("package_id", "state", claim.alias("claim"))
