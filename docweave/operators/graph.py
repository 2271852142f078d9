"""Graph-shaped work as iterative joins.

Long ways are folded before anything walks: a node with one way in stands with the node that this way comes from, pointers double until they reach a node that has several (or none), and what is left of the graph is
folded again as long as that pays. Only then rounds follow the edges. Intermediate tables are written to the shared folder and deleted when no round reads them any more.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import crawl_skip_reason


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one only where that is unset and all runs in one local process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docweave-")
        atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Spool:
    """Tables that grow by pieces, written as Parquet into the shared folder. A piece is computed once, survives lost executors and has no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.pieces, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Write a piece; returns it as read again."""
        self.pieces.append(f"{self.at}/{len(self.pieces)}")
        self.schema = df.schema
        df.write.parquet(self.pieces[-1])
        return self.spark.read.schema(df.schema).parquet(self.pieces[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.pieces)

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again."""
    spool = Spool(df.sparkSession, "cut")
    out = spool.add(df)
    out._cut_to = spool.at
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A fold is repeated as long as it takes away this share of the edges.
WORTH = 0.1


def follow(pointers: DataFrame, rounds: list | None = None, steps: list | None = None) -> DataFrame:
    """node, ahead, off: pointers (node, ahead, off; one a node) followed until they leave the table, off summed up; nodes whose pointers end in a ring are left out. A round doubles the distance.

    ``steps``, if given, gets the table of every distance 1, 2, 4, ... (node, ahead), rings included; those tables are the caller's to drop.
    """
    p = cut(pointers)
    most = p.count().bit_length() + 1  # no way is longer than there are nodes
    for i in range(most):
        if steps is not None:
            steps.append(p)
        ahead = p.select(F.col("node").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("off").alias("_off"))
        moved = F.col("_ahead").isNotNull()
        far = cut(p.join(ahead, "ahead", "left").select("node", F.coalesce("_ahead", "ahead").alias("ahead"), (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off"), moved.alias("moved")))
        if rounds is not None:
            rounds.append("jump")
        if steps is None:
            drop(p)
        p = far
        if p.where("moved").isEmpty():
            break
    done = cut(p.where("NOT moved").select("node", "ahead", "off"))
    drop(p)
    return done


def _fold(e: DataFrame, rounds: list | None, steps: list | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Of edges (u, v, w; one a pair): the edges between nodes with several ways in, each from where the way to its beginning comes from, and node, ahead, off of the folded nodes. None if there are none."""
    ways = e.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"), F.min("w").alias("w")).where("n = 1")
    single = cut(ways.select(F.col("v").alias("node"), F.col("u").alias("ahead"), F.col("w").alias("off")))
    if single.isEmpty():
        drop(single)
        return None
    to = follow(single, rounds, steps)
    rest = e.join(single.select(F.col("node").alias("v")), "v", "left_anti")
    rings = single.join(to.select("node"), "node", "left_anti").select(F.col("node").alias("u"))
    rest = rest.join(rings, "u", "left_anti")
    rest = rest.join(to.select(F.col("node").alias("u"), F.col("ahead").alias("_u"), F.col("off").alias("_w")), "u", "left")
    rest = cut(rest.groupBy(F.coalesce("_u", "u").alias("u"), "v").agg(F.min(F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")))
    drop(single)
    return rest, to


def impact_closure(edges: DataFrame, changed: DataFrame, rounds: list | None = None) -> DataFrame:
    """node, depth: the changed nodes (node) and all that reach one over edges (source -> target: source depends on target), with the length of the shortest way.

    Folded nodes get the depth of the node that they stand with and their distance from it, so chains and trees of n nodes take log2(n) rounds; what has several ways in is
    settled by rounds in which only improved nodes go on. Nulls are no nodes, repeated edges count once, loops and rings are allowed, an empty table of edges leaves the changed nodes.
    ``rounds``, if given, gets an entry for each round.
    """
    start = cut(changed.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0).cast("long")))
    into = F.col("source").alias("v")
    e = edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").select(F.col("target").alias("u"), into).distinct()
    e = cut(e.join(start.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v", F.lit(1).cast("long").alias("w")))
    folds, n = [], e.count()
    while n:
        found = _fold(e, rounds)
        rest = e
        if found:
            rest, to = found
            folds.append(to)
        # what begins nowhere leads nowhere: neither changed nor with a way in
        live = start.select(F.col("node").alias("u")).unionByName(rest.select(F.col("v").alias("u"))).distinct()
        kept = cut(rest.where("u <> v").join(live, "u", "left_semi").select("u", "v", "w"))
        drop(e, *([rest] if found else []))
        e, before, n = kept, n, kept.count()
        if before - n < WORTH * before:
            break
    best, frontier = start, start
    while n and not frontier.isEmpty():
        step = e.join(frontier.select(F.col("node").alias("u"), "depth"), "u").groupBy(F.col("v").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        old = best.select("node", F.col("depth").alias("_old"))
        new = cut(step.join(old, "node", "left").where("_old IS NULL OR depth < _old").select("node", "depth"))
        both = cut(best.join(new.select("node"), "node", "left_anti").unionByName(new))
        drop(best, *([frontier] if frontier is not best else []))
        best, frontier = both, new
        if rounds is not None:
            rounds.append("walk")
    if frontier is not best:
        drop(frontier)
    for to in reversed(folds):
        more = to.join(best.select(F.col("node").alias("ahead"), "depth"), "ahead").select("node", (F.col("depth") + F.col("off")).alias("depth"))
        both = cut(best.unionByName(more))
        drop(best, to)
        best = both
    drop(e)
    return best.select("node", F.col("depth").cast("int").alias("depth"))


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """code, id: duplicate node ids, edges with unknown ends, edges with an invalid relation."""
    twice = nodes.groupBy("id").count().where("count > 1").select(F.lit("duplicate_node").alias("code"), "id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    unknown = ends.join(nodes.select("id").distinct(), "id", "left_anti").select(F.lit("unknown_node").alias("code"), "id")
    bad = edges.where(~F.coalesce("relation", F.lit("")).isin("supports", "derived_from", "depends_on")).select(F.lit("invalid_relation").alias("code"), F.concat_ws("->", "source", "target").alias("id")).distinct()
    return twice.unionByName(unknown).unionByName(bad)


def dependency_cycles(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """node, component: the nodes that lie on a cycle, with the smallest node of their strongly connected component. Empty if and only if there is no cycle.

    Edges that begin where no edge ends, or end where none begins, lie on no cycle and go first. Then nodes with one way in are folded: they lie on a cycle if and only if they lead back to the node that they stand with. Rings of such nodes are components of their own. What is left is parted by colours:
    each node takes the largest name that reaches it, and a component is what its name reaches backwards within its colour; edges between colours lie on no cycle. Nulls are no nodes; an edge
    from a node to itself is a cycle; repeated edges count once. ``rounds``, if given, gets an entry for each round.
    """
    given = edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("u"), F.col("target").alias("v"))
    starts = cut(given.select(F.col("v").alias("u")).distinct())
    # what no edge leads to lies on no cycle: such edges go before any table of edges is made
    all_ = cut(given.join(starts, "u", "left_semi").distinct().withColumn("w", F.lit(1).cast("long")))
    # node and component, with no component where a node is known to lie on a cycle only: it is one alone unless it turns up in another
    found = cut(all_.where("u = v").select(F.col("u").alias("node"), F.lit(None).cast("string").alias("component")))
    e = cut(all_.where("u <> v"))
    drop(starts, all_)
    e = _trimmed(e, rounds)
    levels, n = [], e.count()
    while n:
        steps: list = []
        got = _fold(e, rounds, steps)
        rest = e
        if got:
            rest, to = got
            last = steps[-1]
            ring = last.join(to.select("node"), "node", "left_anti")  # pointers so far on that they end in rings: where they end is a ring
            ends = cut(ring.select(F.col("ahead").alias("node")).distinct())
            if not ends.isEmpty():
                found = _add(found, _rings(steps, ends))
            drop(ends)
            loops = rest.where("u = v").select(F.col("u").alias("node"), F.lit(None).cast("string").alias("component"))
            found = _add(found, loops)
            levels.append((e, to, steps))
        kept = cut(_trim(rest))
        if not got:
            drop(e)
        else:
            drop(rest)
        e = _trimmed(kept, rounds)
        before, n = n, e.count()
        if before - n < WORTH * before:
            break
    if n:
        found = _add(found, _colours(e, rounds))
    drop(e)
    # folded nodes, the last fold first: those that lead back to the component of the node they stand with
    for own, to, steps in reversed(levels):
        comp = found.groupBy("node").agg(F.coalesce(F.min("component"), "node").alias("component"))
        folded = to.select("node", "ahead").join(comp.select(F.col("node").alias("ahead"), "component"), "ahead")
        exits = own.join(to.select(F.col("node").alias("v")), "v", "left_anti").select(F.col("u").alias("node"), "v").join(folded, "node")
        exits = exits.join(comp.select(F.col("node").alias("v"), F.col("component").alias("_c")), "v").where("component = _c")
        marked = cut(exits.select("node").distinct())
        for step in steps:  # all on the way from the node ahead: distances 1, 2, 4, ...
            more = cut(marked.unionByName(marked.join(step, "node").select(F.col("ahead").alias("node"))).distinct())
            drop(marked)
            marked = more
        found = _add(found, folded.join(marked, "node", "left_semi").select("node", "component"))
        drop(own, to, marked, *steps)
    comp = found.groupBy("node").agg(F.coalesce(F.min("component"), "node").alias("_c"))
    names = comp.groupBy("_c").agg(F.min("node").alias("component"))
    out = cut(comp.join(names, "_c").select("node", "component"))
    drop(found)
    return out


def _trim(e: DataFrame) -> DataFrame:
    """The edges (u, v, w) that begin where one ends and end where one begins, without loops."""
    ends = e.select(F.col("u").alias("v")).distinct()
    starts = e.select(F.col("v").alias("u")).distinct()
    return e.where("u <> v").join(starts, "u", "left_semi").join(ends, "v", "left_semi").select("u", "v", "w")


def _trimmed(e: DataFrame, rounds: list | None) -> DataFrame:
    """Edges trimmed as long as a trim takes away its share (WORTH), which costs less than a fold: trees go by half in a round. The table of ``e`` is dropped."""
    n = e.count()
    while n:
        kept = cut(_trim(e))
        drop(e)
        e, before, n = kept, n, kept.count()
        if before - n < WORTH * before:
            break
        if rounds is not None:
            rounds.append("trim")
    return e


def _add(found: DataFrame, more: DataFrame) -> DataFrame:
    out = cut(found.unionByName(more.select("node", "component")))
    drop(found)
    return out


def _rings(steps: list, ends: DataFrame) -> DataFrame:
    """node, component of the nodes of rings of pointers: the smallest name that a node meets on its way round, the way doubling every round."""
    now = cut(steps[0].join(ends, "node", "left_semi").select("node", F.least("node", "ahead").alias("component")))
    for step in steps:
        ahead = now.select(F.col("node").alias("ahead"), F.col("component").alias("_c"))
        more = cut(now.join(step.select("node", "ahead"), "node").join(ahead, "ahead").select("node", F.least("component", "_c").alias("component")))
        drop(now)
        now = more
    return now


def _colours(e: DataFrame, rounds: list | None) -> DataFrame:
    """node, component of the strongly connected components with several nodes, of edges (u, v) without loops."""
    spark, found = e.sparkSession, []
    e = cut(e.select("u", "v"))
    while not e.isEmpty():
        nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        colour = cut(nodes.select("node", F.col("node").alias("colour")))
        frontier = colour
        while not frontier.isEmpty():
            step = e.join(frontier.select(F.col("node").alias("u"), "colour"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("colour"))
            new = cut(step.join(colour.select("node", F.col("colour").alias("_old")), "node").where("colour > _old").select("node", "colour"))
            both = cut(colour.join(new.select("node"), "node", "left_anti").unionByName(new))
            drop(colour, *([frontier] if frontier is not colour else []))
            colour, frontier = both, new
            if rounds is not None:
                rounds.append("colour")
        drop(frontier)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}"))  # noqa: B023, E731
        same = cut(e.join(of("u"), "u").join(of("v"), "v").where("_u = _v").select("u", "v", F.col("_u").alias("colour")))
        back = Spool(spark, "back")
        frontier = back.add(colour.where("node = colour").select("node", "colour"))
        while not frontier.isEmpty():
            step = same.join(frontier.select(F.col("node").alias("v")), "v").select(F.col("u").alias("node"), "colour").distinct()
            frontier = back.add(step.join(back.all().select("node"), "node", "left_anti"))
            if rounds is not None:
                rounds.append("back")
        own = cut(back.all())
        back.delete()
        found.append(own)
        rest = cut(same.join(own.select(F.col("node").alias("u")), "u", "left_anti").join(own.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v"))
        drop(e, same, colour)
        e = rest
    drop(e)
    out = None
    for own in found:
        several = own.groupBy("colour").count().where("count > 1").select("colour")
        part = own.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component"))
        out = part if out is None else out.unionByName(part)
    return out


def link_frontier(pages: DataFrame, links: DataFrame, seeds: DataFrame, host: str, max_depth: int = 2, max_pages: int = 50, **rules) -> DataFrame:
    """url, depth, position: the stored pages (url) that a breadth-first visit from ``seeds`` (url, seq) reaches over links (source, position, target), in queue order, at most ``max_pages``; skipped URLs never enter the queue."""
    ok = crawl_skip_reason(links.select("source", "position", F.col("target").alias("url")), host, **rules).where("reason IS NULL").select("source", "position", "url")
    queue = seeds.select("url", F.lit(0).alias("depth"), F.array(F.col("seq").cast("long")).alias("order"))
    queue = cut(queue.groupBy("url").agg(F.min(F.struct("depth", "order")).alias("m")).select("url", "m.*"))
    level = queue
    for depth in range(1, max_depth + 1):
        step = ok.join(level.join(pages.select("url"), "url", "left_semi").select(F.col("url").alias("source"), "order"), "source")
        step = step.select("url", F.lit(depth).alias("depth"), F.concat("order", F.array(F.col("position").cast("long"))).alias("order"))
        level = cut(step.join(queue.select("url"), "url", "left_anti").groupBy("url").agg(F.min("order").alias("order")).select("url", F.lit(depth).alias("depth"), "order"))
        if level.isEmpty():
            break
        queue = cut(queue.unionByName(level))
    visited = queue.join(pages.select("url").distinct(), "url", "left_semi").orderBy("depth", "order", "url").limit(max_pages)
    return visited.withColumn("position", F.row_number().over(Window.orderBy("depth", "order", "url"))).select("url", "depth", "position")


#: What kind of change an operation makes, and the checks that operations call for.
EDITORIAL = ("course_edit", "page_edit", "skill_request")
SOURCE_CHANGES = ("source_add", "source_update", "source_withdraw", "source_revoke")


def _kind(c: Column) -> Column:
    return F.when(c.startswith("source_") | c.isin("conflict_record", "decision_correct"), "factual").when(c.isin(*EDITORIAL), "editorial").when(c == "policy_change", "mixed").otherwise("unknown")


#: Changes that share a word of a node's state.
WORD = 63


def _numbered_changes(operations: DataFrame) -> DataFrame:
    """change_id, word, bit. Changes are dealt to words by a hash; within a word they are numbered, so that two never share a bit."""
    ids = operations.select("change_id").where("change_id IS NOT NULL").distinct()
    words = max(1, -(-ids.count() // WORD))
    place = F.row_number().over(Window.partitionBy("part").orderBy("change_id")) - 1
    placed = ids.withColumn("part", F.pmod(F.xxhash64("change_id"), F.lit(words))).withColumn("place", place)
    return placed.select("change_id", F.concat_ws("-", F.col("part").cast("string"), F.floor(F.col("place") / WORD).cast("string")).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % WORD).cast("int")).alias("bit"))


def reached_bits(operations: DataFrame, edges: DataFrame, rounds: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, word, bits), (change_id, word, bit): which changes (change_id, target_id) reach a node over edges (source depends on target), 63 changes a row.

    All changes walk together: a node's bits are merged by bit_or before they are shuffled, a round passes on only bits that are new to a node. Neither its frontier nor the state
    is broadcast: their files are small for what they hold, and every round would send them through the driver.
    """
    numbers = cut(_numbered_changes(operations))
    e = cut(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct())
    begin = operations.select("change_id", F.col("target_id").alias("node")).where("node IS NOT NULL").join(numbers, "change_id")
    state = cut(begin.groupBy("node", "word").agg(F.bit_or("bit").alias("bits")))
    frontier = state
    while not frontier.isEmpty():
        step = e.join(frontier.select(F.col("node").alias("target"), "word", "bits").hint("merge"), "target").groupBy(F.col("source").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        old = state.select("node", "word", F.col("bits").alias("_old")).hint("merge")
        new = step.join(old, ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long")))))
        new = cut(new.where("bits <> 0").select("node", "word", "bits"))
        both = cut(state.unionByName(new).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
        drop(state, *([frontier] if frontier is not state else []))
        state, frontier = both, new
        if rounds is not None:
            rounds.append("walk")
    drop(e, *([frontier] if frontier is not state else []))
    return state, numbers


def affected_nodes(operations: DataFrame, edges: DataFrame) -> DataFrame:
    """change_id, node: the targets of every change (change_id, target_id) and all nodes that depend on one."""
    state, numbers = reached_bits(operations, edges)
    return state.join(numbers, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("change_id", "node")


def change_impact(operations: DataFrame, edges: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """change_id, classification, checks (sorted), targets, affected, blockers, unknown_dependencies: of operations (change_id, type, target_id), with the number of nodes that the change reaches.

    ``unknown`` names the changes (change_id) whose graph says itself that it does not know all dependencies: they carry the blocker DEPENDENCY_UNKNOWN. Counts are read off the nodes' bits, so no
    row stands for a (change, node) pair; ``affected_nodes`` lists the nodes. Null targets count as none.
    """
    g = operations.groupBy("change_id").agg(F.collect_set(_kind(F.col("type"))).alias("kinds"), F.collect_set("type").alias("types"), F.count_distinct("target_id").alias("targets"))
    classification = F.when((F.size("kinds") > 1) | F.array_contains("kinds", "mixed"), "mixed").otherwise(F.coalesce(F.try_element_at("kinds", F.lit(1)), F.lit("unknown")))
    has = lambda names: F.arrays_overlap("types", F.array(*map(F.lit, names)))
    none = F.array().cast("array<string>")
    names = lambda *xs: F.array(*map(F.lit, xs))
    checks = F.concat(names("contract", "dependency_graph"), F.when(has(SOURCE_CHANGES), names("rights", "privacy", "retrieval", "revocation")).otherwise(none), F.when(has(EDITORIAL), names("derivatives", "golden", "editorial_review")).otherwise(none), F.when(has(("page_edit",)), names("commercial_decision")).otherwise(none))
    state, numbers = reached_bits(operations, edges)
    # nodes with a bit, by word and place: 63 sums a word
    at = [F.sum(F.call_function("shiftright", F.col("bits"), F.lit(i)).bitwiseAND(F.lit(1))).alias(f"n{i}") for i in range(WORD)]
    sums = state.groupBy("word").agg(*at)
    counts = sums.select("word", F.posexplode(F.array(*[F.col(f"n{i}") for i in range(WORD)])).alias("place", "affected"))
    counts = counts.withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).join(numbers, ["word", "bit"]).select("change_id", "affected")
    flagged = F.lit(False)
    out = g.join(counts, "change_id", "left")
    if unknown is not None:
        out = out.join(unknown.select("change_id", F.lit(True).alias("_unknown")).distinct(), "change_id", "left")
        flagged = F.coalesce("_unknown", F.lit(False))
    blockers = F.when(flagged, names("DEPENDENCY_UNKNOWN")).otherwise(none)
    return out.select("change_id", classification.alias("classification"), F.array_sort(checks).alias("checks"), "targets", F.coalesce("affected", F.lit(0)).cast("long").alias("affected"), blockers.alias("blockers"), flagged.alias("unknown_dependencies"))
