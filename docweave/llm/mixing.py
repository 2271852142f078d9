"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree. DataFrame operations only.

1. Sources get targets in words: weights shared out, cut off at ``ceiling`` times a source's words, the excess shared again (a water level,
   found in closed form from sorted ratios).
2. Each source's documents are permuted by a hash and cut into blocks. A source draws blocks in that order, going round again after the
   last, until its target is met; the block where the target falls is drawn in part, to come close.
3. How many of a source's block draws each output shard gets is decided by a tree: at every node, the node's blocks (exact counts by source)
   are split between its halves by a draw from the multivariate hypergeometric distribution, so quotas add up at every level.
4. The shards take the draws in order, disjoint ranges as long as their quotas, and order their documents by a hash (shuffle locally).

Every random choice is a hash of a seed, so runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, output_columns, spool, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
#: Words that a block should hold, and the most blocks a source is cut into: beyond that blocks grow with the source.
BLOCK_WORDS = 4096
MOST_BLOCKS = 65536
SHARDS = 16
#: Sources whose quotas stand in one row of the tree.
SOURCES_TOGETHER = 512
SEED = 20240601


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources in code-point order (null last) weigh ``weights``, repeating. They share ``share`` times all words by weight; no target exceeds
    ``ceiling`` times its source's words; what is above is shared among the others by weight until none is above. A source without words
    gets 0. The table has a row a source, so its two windows are small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = by_source.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    # from the smallest ratio of cap to weight: sources are at their cap as long as the level that the rest then gets is not below their ratio
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "capped": F.coalesce(F.sum("cap").over(up), F.lit(0.0)),
        "rest": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up), F.lit(0.0)),
        "pool": F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)),
    })
    level = F.max(F.when(F.col("cap") / F.col("w") >= (F.col("pool") - F.col("capped")) / F.col("rest"), (F.col("pool") - F.col("capped")) / F.col("rest"))).over(everything)
    return s.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def _uniform(*keys) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _hypergeometric(u: Column, all_: Column, good: Column, drawn: Column) -> Column:
    """How many of ``drawn`` blocks are among the ``good`` ones of ``all_``: the inverse of the distribution function at ``u``.

    Probabilities come from their ratios, over the whole support or 12 standard deviations around the mean (what lies beyond has less
    probability than a double can tell from 0). Two folds: the sum of all, then how many stay below u of it.
    """
    zero = F.lit(0).cast("long")
    share = good / F.greatest(all_, F.lit(1))
    mean = drawn * share
    sd = F.sqrt(mean * (F.lit(1.0) - share) + 1)
    lo, hi = F.greatest(zero, drawn + good - all_), F.least(good, drawn)
    a = F.greatest(lo, F.floor(mean - 12 * sd - 12))
    b = F.least(hi, F.ceil(mean + 12 * sd + 12))
    support = F.sequence(a, b - 1)

    def ratio(k):  # of the probability of k + 1 to that of k
        return (good - k) * (drawn - k) / ((k + 1) * (all_ - good - drawn + k + 1))

    def add(acc, k):
        return F.struct((acc["p"] * ratio(k)).alias("p"), (acc["upto"] + acc["p"] * ratio(k)).alias("upto"))

    one = F.lit(1.0)
    total = F.aggregate(support, F.struct(one.alias("p"), one.alias("upto")), add, lambda acc: acc["upto"])

    def count(acc, k):
        p = acc["p"] * ratio(k)
        return F.struct(p.alias("p"), (acc["upto"] + p).alias("upto"), (acc["n"] + F.when(acc["upto"] < acc["goal"], 1).otherwise(0)).alias("n"), acc["goal"].alias("goal"))

    start = F.struct(one.alias("p"), one.alias("upto"), zero.alias("n"), (u * total).alias("goal"))
    return F.when(hi <= lo, lo).otherwise(a + F.aggregate(support, start, count, lambda acc: acc["n"]))


def _draws(counts: str, all_: str, drawn: str, *keys) -> Column:
    """How many of ``drawn`` blocks fall to each entry of ``counts`` (array of struct<s, n>), given what is left after those before it. An array of the same form."""

    def draw(acc, x):
        got = _hypergeometric(_uniform(*keys, x["s"]), acc["all"], x["n"], acc["drawn"])
        once = F.transform(F.array(got), lambda g: F.struct((acc["all"] - x["n"]).alias("all"), (acc["drawn"] - g).alias("drawn"), F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), g.alias("n")))).alias("out")))
        return once[0]

    start = F.struct(F.col(all_).alias("all"), F.col(drawn).alias("drawn"), F.array().cast("array<struct<s:bigint,n:bigint>>").alias("out"))
    return F.aggregate(counts, start, draw, lambda acc: acc["out"])


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED, together: int = SOURCES_TOGETHER) -> DataFrame:
    """source_rank, shard, n: how many of each source's block draws every shard gets, from (source_rank long, quota long).

    A row a node, level and group of ``together`` sources, with the group's counts by source in an array. At a node with m shards, the left half takes
    round(blocks * left / m) blocks. How many of these come from each group of sources, and then within a group from each source, is hypergeometric given what is left; drawing groups
    first is the same distribution, and no row holds more than ``together`` sources or the groups.
    """
    entry = lambda s, n: F.array_sort(F.collect_list(F.struct(F.col(s).cast("long").alias("s"), F.col(n).cast("long").alias("n"))))
    tree = quotas.groupBy(F.floor(F.col("source_rank") / together).alias("group")).agg(entry("source_rank", "quota").alias("counts"))
    tree = tree.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("width"), "group", "counts")
    level = 0
    while (1 << level) < shards:
        tree = tree.withColumn("blocks", F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))
        nodes = tree.groupBy("first", "width").agg(entry("group", "blocks").alias("groups"), F.sum("blocks").alias("all"))
        nodes = nodes.withColumn("left", F.floor((F.col("width") + 1) / 2))
        nodes = nodes.withColumn("take", F.when(F.col("width") > 1, F.floor(F.col("all") * F.col("left") / F.col("width") + 0.5)).otherwise(F.col("all")))
        takes = nodes.withColumn("takes", _draws("groups", "all", "take", F.lit(seed), F.lit(level), F.col("first"), F.lit("group"))).select("first", "left", F.inline("takes")).select("first", "left", F.col("s").alias("group"), F.col("n").alias("take"))
        tree = tree.join(takes, ["first", "group"])
        tree = tree.withColumn("lefts", _draws("counts", "blocks", "take", F.lit(seed), F.lit(level), F.col("first")))
        rights = F.zip_with("counts", "lefts", lambda c, x: F.struct(c["s"].alias("s"), (c["n"] - x["n"]).alias("n")))
        halves = F.array(
            F.struct(F.col("first").alias("first"), F.when(F.col("width") > 1, F.col("left")).otherwise(F.col("width")).alias("width"), F.col("group").alias("group"), F.col("lefts").alias("counts")),
            F.struct((F.col("first") + F.col("left")).alias("first"), (F.col("width") - F.col("left")).alias("width"), F.col("group").alias("group"), rights.alias("counts")),
        )
        tree = spool(tree.select(F.inline(F.filter(halves, lambda h: h["width"] > 0))), "mix-tree")
        level += 1
    return tree.select(F.col("first").alias("shard"), F.inline("counts")).select(F.col("s").alias("source_rank"), "shard", "n")


def _fill(cut: DataFrame) -> DataFrame:
    """extra: which documents of the one block of a source where the target falls are drawn once more.

    Three times, what still fits is taken from the largest down as far as the sum allows; at last the smallest document left is taken if
    that comes closer. A block is at most 1 / MOST_BLOCKS of a source or BLOCK_WORDS words (or one longer document).
    """
    whole = Window.partitionBy("source_rank")
    gap = F.col("over") - F.col("before") - F.sum(F.col("size") * F.col("extra")).over(whole)
    cut = cut.withColumn("extra", F.lit(0))
    for _ in range(3):
        cut = cut.withColumn("_gap", gap)
        fits = (F.col("extra") == 0) & (F.col("size") <= F.col("_gap"))
        down = whole.orderBy(F.col("_fits").desc(), F.col("size").desc(), "row_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        cut = cut.withColumn("_fits", fits).withColumn("_upto", F.sum(F.when(F.col("_fits"), F.col("size"))).over(down))
        cut = cut.withColumn("extra", F.when(F.col("_fits") & (F.col("_upto") <= F.col("_gap")), 1).otherwise(F.col("extra")))
    small = whole.orderBy((F.col("size") == 0), "extra", "size", "row_key", "doc_id")
    cut = cut.withColumn("_gap", gap).withColumn("_n", F.row_number().over(small))
    closer = (F.col("_n") == 1) & (F.col("extra") == 0) & (F.col("size") < 2 * F.col("_gap"))
    return cut.withColumn("extra", F.when(closer, 1).otherwise(F.col("extra"))).drop("_gap", "_fits", "_upto", "_n")


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What the mix takes of each document: doc_id, row_key, source, size, source_size, target, draws (array of struct<shard, place>: one each time the document is drawn).

    Null text has size 0 and is never drawn; documents without words have nothing to take. A null source is a source of its own. Repeated
    rows are permuted like others. No document is drawn more often than ceil(ceiling) times.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = spool(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("row_key")), "mix-sizes")
    rank = F.dense_rank().over(Window.orderBy(F.col("source").asc_nulls_last()))
    targets = source_targets(sized, weights, share, ceiling).withColumn("source_rank", rank.cast("long"))
    targets = spool(targets.withColumn("n_blocks", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / F.lit(block_words))).cast("long")), "mix-targets")

    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(sized["*"], "source_rank", "source_size", "target", "n_blocks")
    rows = rows.withColumn("block", F.pmod("row_key", F.greatest("n_blocks", F.lit(1))))
    # words before each block within its source: a prefix sum over at most MOST_BLOCKS rows a source, in two steps
    blocks = rows.groupBy("source_rank", "block").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("block") / 64))
    groups = blocks.groupBy("source_rank", "group").agg(F.sum("words").alias("_words"))
    groups = groups.withColumn("_before", F.sum("_words").over(Window.partitionBy("source_rank").orderBy("group")) - F.col("_words"))
    inside = F.sum("words").over(Window.partitionBy("source_rank", "group").orderBy("block")) - F.col("words")
    blocks = blocks.withColumn("_inside", inside).join(groups.select("source_rank", "group", "_before"), ["source_rank", "group"])
    blocks = blocks.select("source_rank", "block", (F.col("_inside") + F.col("_before")).alias("before"), "words")
    blocks = blocks.join(targets.select("source_rank", "source_size", "target", "n_blocks"), "source_rank")
    # the draws: whole rounds through the source, then blocks up to the one where the target falls
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    blocks = blocks.withColumns({"rounds": rounds, "over": F.col("target") - rounds * F.col("source_size")})
    part = F.when(F.col("before") + F.col("words") <= F.col("over"), "whole").when(F.col("before") < F.col("over"), "cut").otherwise("none")
    blocks = spool(blocks.select("source_rank", "block", "before", "over", "rounds", "n_blocks", part.alias("part")), "mix-blocks")

    quotas = blocks.groupBy("source_rank").agg((F.max(F.col("rounds") * F.col("n_blocks")) + F.coalesce(F.max(F.when(F.col("part") != "none", F.col("block") + 1)), F.lit(0))).alias("quota"))
    by_shard = split_quotas(quotas, shards, seed)
    upto = F.sum("n").over(Window.partitionBy("source_rank").orderBy("shard"))
    ends = by_shard.withColumn("upto", upto).groupBy("source_rank").agg(F.array_sort(F.collect_list("upto")).alias("ends"))

    planned = rows.join(blocks.drop("n_blocks"), ["source_rank", "block"]).join(spool(ends, "mix-quotas"), "source_rank")
    cut = _fill(planned.where(F.col("part") == "cut"))
    rest = planned.where(F.col("part") != "cut").withColumn("extra", (F.col("part") == "whole").cast("int"))
    taken = cut.unionByName(rest).withColumn("copies", F.when(F.col("size") > 0, F.col("rounds") + F.col("extra")).otherwise(F.lit(0)).cast("int"))
    number = lambda i: F.col("block") + i * F.col("n_blocks")  # noqa: E731  of the draw, round by round
    shard_of = lambda i: F.aggregate("ends", F.lit(0), lambda acc, e: acc + F.when(e <= number(i), 1).otherwise(0))
    draws = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(shard_of(i).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("row_key"), i).alias("place")))
    return taken.select("doc_id", "row_key", "source", "size", "source_size", "target", "copies", draws.alias("draws"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is drawn, with the columns of ``docs`` and mix_shard, mix_place.

    Sort a shard by mix_place to write it: that is its local shuffle. Repeated (doc_id, text) rows are drawn alike, each as often as the others.
    """
    seed = how.get("seed", SEED)
    plan = mix_plan(docs, **how).where("copies > 0").groupBy("doc_id", "row_key").agg(F.first("draws").alias("draws"))
    keep = output_columns(docs, ["mix_shard", "mix_place"])
    keyed = docs.select(*keep, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_row_key"))
    plan = plan.select(F.col("doc_id").alias("_doc_id"), F.col("row_key").alias("_plan_key"), F.col("draws").alias("_draws"))
    drawn = keyed.join(plan, keyed["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("_row_key") == F.col("_plan_key")))
    return drawn.select(*keep, F.explode("_draws").alias("_draw")).select(*keep, F.col("_draw.shard").alias("mix_shard"), F.col("_draw.place").alias("mix_place"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix in the order in which it is to be written: range-partitioned by shard and place and sorted, so each shard lies together, shuffled locally. Without mix_shard and mix_place."""
    return mixed.repartitionByRange("mix_shard", "mix_place").sortWithinPartitions("mix_shard", "mix_place").drop("mix_shard", "mix_place")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    shards = F.transform("draws", lambda d: d["shard"])
    return plan.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", F.array_join(F.transform(shards, lambda x: x.cast("string")), " ").alias("shards"))
