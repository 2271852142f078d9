"""A Merkle tree over a dataset, and the proof of every row, by pointer jumping.

Rows are leaves of their source's tree, the sources' roots are leaves of one tree above. 16 nodes that follow each other become one. Every node but the root holds a pointer to
an ancestor and the segment of siblings on the way there: at first its parent and the others of its run. A round joins the table with itself, each node with the one that its
pointer names, appends that one's segment and takes over its pointer, so distances double and a few rounds lead every node to the root. Leaves stay in the row of
their run until the end (16 at most): the run's segment is joined once, and each leaf puts its own siblings in front.

Texts are read once and leave the task as digests. Places in a source come from a range partition and the counts of its parts, so no task sees a whole source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, spool, table, unspool
from .spelling import _TABLE, CRC32

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree above the sources' trees.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """sha256 of the fields one after another: ``-`` for null, else the bytes' number, a colon and the value as text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def in_order(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds place (from 0 within ``by``, the first columns of ``order``) and spools. Rows are dealt by ranges and sorted; a part's rows get its start from the counts of all parts."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = spool(dealt.withColumn("_part", F.call_function("shiftright", F.col("_id"), F.lit(33)).cast("int")), name)
    parts = dealt.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a row for every part of a source; without ``by`` for every part of the table
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_of"), "_first", before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_of"))
    found = dealt.join(parts, same).withColumn("place", F.col("_before") + F.col("_id") - F.col("_first"))
    out = spool(found.drop("_id", "_part", "_of", "_first", "_before", *[f"_{c}" for c in by]), name)
    unspool(dealt)
    return out


def _others(children: str, i: Column) -> Column:
    """left and right: the digests before and behind number ``i`` of a run."""
    digests = F.col(f"{children}.digest")
    return F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.greatest(F.size(digests) - i - 1, F.lit(0))), "").alias("right"))


def _level(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (node struct, tree, level, place, n, digest), all with n > 1: their pointers (node, ahead, segment), and the nodes made of their runs. A run is a row of at most RUN children."""
    child = F.struct("place", "node", "digest")
    runs = nodes.groupBy("tree", "level", F.floor(F.col("place") / RUN).alias("run"), "n").agg(F.array_sort(F.collect_list(child)).alias("children"))
    parent = F.struct("tree", (F.col("level") + 1).alias("level"), F.col("run").alias("place"))
    runs = spool(runs.select(parent.alias("parent"), "n", "children", F.sha2(F.array_join("children.digest", ""), 256).alias("digest")), "merkle-runs")
    links = runs.select("parent", "children", F.posexplode("children").alias("i", "child")).select(F.col("child.node").alias("node"), F.col("parent").alias("ahead"), F.array(_others("children", F.col("i"))).alias("segment"))
    up = runs.select(F.col("parent").alias("node"), "parent.*", F.ceil(F.col("n") / RUN).cast("long").alias("n"), "digest")
    return links, up


def _grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels until every tree (the largest has ``most`` nodes) is one node: all pointers, and the last nodes (tree, node, digest)."""
    links, tops = [], []
    while most > 1:
        tops.append(nodes.where("n = 1").select("tree", "node", "digest"))
        more, nodes = _level(nodes.where("n > 1"))
        links.append(more)
        most = -(-most // RUN)
    return links, reduce(DataFrame.unionByName, [*tops, nodes.select("tree", "node", "digest")])


def jump(links: DataFrame) -> DataFrame:
    """Pointers (node, ahead, segment) until each leads to a node without one: node, segment. As a round doubles every distance, a tree of depth d takes log2(d) rounds."""
    links = spool(links, "merkle-jumps")
    while True:
        next_ = links.select(F.col("node").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("segment").alias("_segment"))
        far = links.join(next_, "ahead", "left")
        moved = F.col("_ahead").isNotNull()
        far = far.select("node", F.coalesce("_ahead", "ahead").alias("ahead"), F.when(moved, F.concat("segment", "_segment")).otherwise(F.col("segment")).alias("segment"), moved.alias("moved"))
        far = spool(far, "merkle-jumps")
        unspool(links)
        links = far
        if links.where("moved").isEmpty():
            return links.select("node", "segment")


def fold(start: Column, segments: Column) -> Column:
    """The root that a digest and the siblings on its way (array of left and right) lead to."""
    return F.aggregate(segments, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proofs(docs: DataFrame, tampered: Column, altered: list[Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, segments, changed of every row of (doc_id, source, lang, n_chars, text); segments are the siblings left and right, level by level up to the root, changed is the leaf's digest where ``tampered`` holds and the fields are ``altered``, else null.

    Nulls are a value of their own (``-``), so an empty text has another digest; a null source is a source, the first; null doc_ids come first in theirs. Rows that repeat a doc_id follow each other by
    digest; rows that repeat all fields have equal leaves, so their order does not matter. Texts of any length leave a task as digests. Further columns, whatever their names, are neither hashed nor
    returned. An empty table gives no rows. One row alone is its own root, and its proof has no siblings.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", leaf_hash([F.col(c) for c in FIELDS]).alias("leaf"), F.when(tampered, leaf_hash(altered or [F.col(c) for c in FIELDS])).alias("changed"))
    # the number of a row in the first pass tells equal rows apart, so that they need not all lie in one range
    rows = spool(rows.withColumn("_tie", F.monotonically_increasing_id()), "merkle-rows")
    source, doc = F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first()
    placed = in_order(rows, ["source"], [source, doc, F.col("leaf"), F.col("_tie")], "merkle-leaves")
    unspool(rows)
    sources = in_order(placed.groupBy("source").agg(F.count(F.lit(1)).alias("n")), [], [source], "merkle-sources").withColumnRenamed("place", "tree")
    count = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most")).first()
    if not count["sources"]:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, segments array<struct<left: string, right: string>>, changed string")
    of = sources.select(F.col("source").alias("_source"), "tree", "n")
    leaves = placed.join(of, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "n", "place", "doc_id", "leaf", "changed")

    # the lowest runs hold their leaves; a leaf without others stands as a run of its own that is no node
    child = F.struct("place", "doc_id", F.col("leaf").alias("digest"), "changed")
    runs = leaves.groupBy("tree", "n", F.floor(F.col("place") / RUN).alias("run")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    node = F.struct(F.col("tree"), F.when(F.col("n") > 1, 1).otherwise(0).alias("level"), F.col("run").alias("place"))
    digest = F.when(F.col("n") > 1, F.sha2(F.array_join("children.digest", ""), 256)).otherwise(F.col("children")[0]["digest"])
    runs = spool(runs.select(node.alias("node"), "n", digest.alias("digest"), "children"), "merkle-leaf-runs")
    unspool(placed)

    nodes = runs.select("node", "node.*", F.ceil(F.col("n") / RUN).cast("long").alias("n"), "digest")
    links, subroots = _grow(nodes, -(-count["most"] // RUN))
    subroots = spool(subroots, "merkle-subroots")
    top = subroots.select("node", F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), F.lit(count["sources"]).cast("long").alias("n"), "digest")
    more, root = _grow(top, count["sources"])
    root = root.select(F.col("digest").alias("root")).first()["root"]  # one digest

    out = runs.select("node", "children")
    if links or more:
        far = jump(reduce(DataFrame.unionByName, [*links, *more]))
        out = out.join(far, "node", "left")
    else:
        out = out.withColumn("segment", F.lit(None).cast("array<struct<left: string, right: string>>"))
    out = out.join(subroots.select(F.col("tree").alias("_tree"), F.col("digest").alias("subroot")), F.col("node.tree") == F.col("_tree"))
    out = out.select("node", "children", "segment", "subroot", F.posexplode("children").alias("i", "child"))
    above = F.coalesce("segment", F.array().cast("array<struct<left: string, right: string>>"))
    segments = F.when(F.col("node.level") == 0, above).otherwise(F.concat(F.array(_others("children", F.col("i"))), above))
    return out.select("child.doc_id", F.col("child.digest").alias("leaf"), "subroot", F.lit(root).alias("root"), segments.alias("segments"), "child.changed")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    found = proofs(docs, held_out(F.col("doc_id"), 5, 0), altered)
    siblings = F.array_join(F.transform("segments", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("segments")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
#: Levels of every tree, and each node's siblings left and right in its run.
_NODES = """
  {name} AS (
    SELECT tree, 0 AS level, place, n, digest FROM {start}
    UNION ALL
    SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, level, place // 16, n)"""
_SIBLINGS = """
  {name}_by AS (
    SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name})"""
OP13_SQL = f"""
WITH RECURSIVE crc AS ({_TABLE}),
  rows_ AS (
    SELECT row_number() OVER () AS id, doc_id, source, {_LEAF} AS leaf,
      CASE WHEN {CRC32.format(x="coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 THEN {_LEAF.replace("text", f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
    FROM documents, crc),
  trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM rows_ GROUP BY source),
  leaves AS (SELECT id, doc_id, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS digest, changed FROM rows_ JOIN trees ON rows_.source IS NOT DISTINCT FROM trees.source),
  {_NODES.format(name="low", start="leaves")}, {_SIBLINGS.format(name="low")},
  roots AS (SELECT tree, digest FROM low WHERE n = 1),
  tops AS (SELECT 0 AS tree, roots.tree AS place, (SELECT count(*) FROM roots) AS n, digest FROM roots),
  {_NODES.format(name="high", start="tops")}, {_SIBLINGS.format(name="high")},
  walk AS (
    SELECT id, tree AS own, false AS high, 0 AS level, place, digest, coalesce(changed, digest) AS acc, '' AS proof, n FROM leaves
    UNION ALL
    SELECT w.id, w.own, w.high OR w.n = 1, CASE WHEN w.n = 1 AND NOT w.high THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 AND NOT w.high THEN w.own ELSE w.place // 16 END, w.digest,
      CASE WHEN w.n = 1 AND NOT w.high THEN w.acc ELSE sha256(coalesce(a.l, b.l) || w.acc || coalesce(a.r, b.r)) END,
      CASE WHEN w.n = 1 AND NOT w.high THEN w.proof ELSE w.proof || coalesce(a.l, b.l) || coalesce(a.r, b.r) END,
      CASE WHEN w.n = 1 AND NOT w.high THEN (SELECT count(*) FROM roots) ELSE (w.n + 15) // 16 END
    FROM walk w LEFT JOIN low_by a ON NOT w.high AND a.tree = w.own AND a.level = w.level AND a.place = w.place LEFT JOIN high_by b ON w.high AND b.level = w.level AND b.place = w.place
    WHERE NOT (w.high AND w.n = 1)),
  top AS (SELECT digest FROM high WHERE n = 1)
SELECT leaves.doc_id, leaves.digest AS leaf, roots.digest AS subroot, top.digest AS root, sha256(walk.proof) AS proof_sha256, walk.acc AS folded_root, walk.acc = top.digest AS verified
FROM leaves JOIN walk ON leaves.id = walk.id AND walk.high AND walk.n = 1 JOIN roots ON roots.tree = leaves.tree, top
"""
