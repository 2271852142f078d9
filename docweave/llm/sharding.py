"""Sharding by longest-processing-time scheduling: documents of equal text stay together, the largest groups are placed first, each on the
shard that has least so far (a heap).

Groups of equal size are alike to the schedule, so the heap takes them size by size with their number, not one by one: sizes are told apart to
CLASSES steps between powers of two (below CLASSES bytes every size is a class of its own), at most a few ten thousand classes at any scale. The
driver sees (class, groups, bytes) and gives out, for each class, how many of its groups every shard gets and in which order; which groups these are is settled
in Spark by their number within the class. One rule holds at every size of table, and no group is split.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import output_columns, spool, table

SHARDS = 8
CLASSES = 1024
#: Rows that are numbered together when places and slots are given out.
ROWS_TOGETHER = 20_000


def lpt(classes: list[tuple[int, int, float]], shards: int) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """class -> (ends, owners, cycle), from (class, groups, bytes), largest class first. The groups of a class are numbered from 0; those below ends[0] go to shard owners[0],
    those from there below ends[1] to owners[1], and so on; what is left goes round through ``cycle``.

    Each group goes to the shard with least so far (ties: smaller shard). As long as loads differ by more than a group, that fills shards up to a level, the lowest first, so they
    get their groups at once; then the heap gives the order in which the rest goes round.
    """
    loads = [0.0] * shards
    placed = {}
    for c, n, size in sorted(classes, key=lambda x: -x[0]):
        each = size / n
        fill = lambda level: [max(0, int((level - load) // each)) for load in loads]  # noqa: B023, E731
        low, high = min(loads), max(loads)
        given = fill(high)
        if sum(given) > n:  # the class does not reach the highest shard: the highest level that it does reach
            for _ in range(64):
                middle = (low + high) / 2
                low, high = (middle, high) if sum(fill(middle)) <= n else (low, middle)
            given = fill(low)
        owners = [s for s in range(shards) if given[s]]
        ends, done = [], 0
        for s in owners:
            done += given[s]
            loads[s] += given[s] * each
            ends.append(done)
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        cycle = [heapq.heappop(heap)[1] for _ in range(shards)]
        rounds, rest = divmod(n - done, shards)
        for i, s in enumerate(cycle):
            loads[s] += (rounds + (i < rest)) * each
        placed[c] = (ends, owners, cycle)
    return placed


def size_class(size: Column) -> Column:
    """A number that grows with the size: sizes below CLASSES are their own, above there are CLASSES / 2 classes between powers of two, all of one width."""
    bits = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - (CLASSES.bit_length() - 2), F.lit(0))
    bits = F.when(F.call_function("shiftright", size, bits) >= CLASSES, bits + 1).when((bits > 0) & (F.call_function("shiftright", size, bits) < CLASSES // 2), bits - 1).otherwise(bits)  # logarithms round
    return (bits.cast("long") * (CLASSES // 2) + F.call_function("shiftright", size, bits)).cast("long")


def _numbered(rows: DataFrame, by: list[str], order: list[str], buckets: Column | int) -> DataFrame:
    """Adds number: from 0 without gaps within ``by``, in an order of hash buckets of ``order`` and then of ``order``. A prefix sum over buckets, then numbers within them, so no task numbers more than a bucket."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets) if isinstance(buckets, int) else buckets))
    sizes = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(before, [*by, "_bucket"]).withColumn("number", (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_before", "_inside")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, text_key, shard, slot.

    size is the UTF-8 bytes of the text plus 1, text_crc32 that of the bytes; null text counts as the empty text. Groups are equal
    texts, told by a 64-bit hash (two texts that share it would merely stay together too). slot numbers a shard's documents from 0 without gaps; within a
    shard the order is by a hash of doc_id, so that large groups spread out, then by doc_id and text; rows that repeat both follow each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_key"))
    rows = spool(rows, "shard-rows")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = spool(groups.withColumn("class", size_class(F.col("bytes"))), "shard-groups")
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()  # CLASSES / 2 for each power of two: bounded
    placed = lpt([(r["class"], r["n"], float(r["bytes"])) for r in classes], shards)
    rule = spark.createDataFrame([(c, *p, max(1, -(-n // ROWS_TOGETHER))) for c, p, n in ((r["class"], placed[r["class"]], r["n"]) for r in classes)], "class long, ends array<long>, owners array<int>, cycle array<int>, buckets long")

    of = _numbered(groups.join(F.broadcast(rule), "class"), ["class"], ["text_key"], F.col("buckets"))
    early = F.size(F.filter("ends", lambda e: e <= F.col("number")))  # how many ranges end at or before the number
    turn = F.pmod(F.col("number") - F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)), F.lit(shards)).cast("int")
    shard = F.coalesce(F.get("owners", early), F.get("cycle", turn))
    total = rows.count()
    of = spool(of.select("text_key", "rows", shard.alias("shard")), "shard-of")
    # texts of at least one in 1,024 rows, at most 1,024 of them, are told to all tasks; so no text's rows have to meet in one task
    hot = of.where(F.col("rows") * 1024 >= total).select("text_key", "shard")
    rest = rows.join(F.broadcast(hot), "text_key", "left_anti").join(of.select("text_key", "shard"), "text_key")
    rows = rows.join(F.broadcast(hot), "text_key").unionByName(rest)
    rows = _numbered(rows, ["shard"], ["doc_id", "text_key"], max(1, -(-total // ROWS_TOGETHER)))
    return rows.select("doc_id", "size", "text_crc32", "text_key", "shard", F.col("number").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents with all their columns as Parquet, one folder a shard (shard=0, shard=1, ...).

    Columns of ``docs`` named shard or slot are replaced. Documents are told apart by doc_id and text; rows that repeat both get one slot each.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    # rows that repeat (doc_id, text) have slots one after another: the first of them and a number
    found = assign(docs, shards).groupBy("doc_id", "text_key").agg(F.first("shard").alias("shard"), F.min("slot").alias("slot"))
    keep = output_columns(docs, ["shard", "slot"])
    again = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(F.lit(0))) - 1
    keyed = docs.select(*keep, key.alias("_key")).withColumn("_again", again)
    found = found.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "shard", "slot")
    both = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_text_key")))
    both.select(*keep, "shard", (F.col("slot") + F.col("_again")).alias("slot")).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
