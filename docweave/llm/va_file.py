"""Exact top-k search with a vector-approximation file.

Two files hold the vectors: cells (each component's number among 2**BITS intervals of that dimension) and the exact vectors. Intervals balance depth and width, are cut by a bounded sample and then
measured over all rows: a cell knows the least and the largest component that lies in it. There are fewer cells than values, so a cell stands for several, and the product of a query with
a row lies within that row's own slack of the product with its cells' middles.

A search scans cells only. Before it, each query is compared with the sample; no row whose upper bound lies below the kth score found there can be among its best, so a task only sends rows that still
may be, however many tasks there are. Exact vectors are then read in the order of the bounds, in two steps: the 2 * k rows with the highest upper bounds of each query give its kth score; what has a bound
that reaches that score is read and looked at by descending bound until the kth result is certain.

Queries go out in chunks of a fixed size to all tasks (so a broadcast never grows with the data); each chunk scans the cells once. Scores are
integers, exact for all components below 2**31 / sqrt(dimensions).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, spool, table, unspool
from .vectors import dimensions, first_copies, matrix, ranked, usable

K = 20
#: Bits of a cell number: 32 cells a dimension.
BITS = 5
#: Rows that the cuts are taken from and that give the first threshold: those with the smallest hash of vec_id. Cells and their extents are those of all rows.
SAMPLE_ROWS = 8192
#: Queries that are sent out together, and rows and queries that are looked at together in a task.
QUERIES_TOGETHER, ROWS_TOGETHER, BLOCK = 32768, 4096, 512
SCALE = 64


def cuts(sample: np.ndarray, bits: int = BITS) -> np.ndarray:
    """By dimension 2**bits - 1 ascending cuts (dimensions as rows); component x lies in the cell that counts the cuts at or below x. Cells balance depth and width: each holds an equal part of the sum of
    sqrt(rows * gap) over the sample's values, which makes the expected width of a row's cell least. There is at most a cell for two values, so cells stay coarser than values."""
    out = []
    for column in sample.T:
        values, rows = np.unique(column, return_counts=True)
        most = min(1 << bits, max(1, len(values) // 2))
        part = np.sqrt(rows * np.diff(values.astype(np.float64), append=values[-1] + 1.0))
        cell = ((np.cumsum(part) - part / 2) / part.sum() * most).astype(np.int64)
        at = values[1:][cell[1:] != cell[:-1]]
        out.append(np.concatenate((at, np.full((1 << bits) - 1 - len(at), np.iinfo(np.int64).max))))
    return np.array(out, np.int64)


def codes(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(cut[j], x[:, j], side="right") for j in range(x.shape[1])], axis=1).astype(np.uint8)


def build(vectors: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame, dict, tuple[np.ndarray, np.ndarray]]:
    """Of (vec_id, vector array<bigint>), all of one length: the exact file, the cells (vec_id, cell binary), the grid (middle and half width of every cell, as dimensions by cells), and the sample (ids, vectors)."""
    ship(vectors.sparkSession)
    file = spool(vectors.select("vec_id", "vector"), "va-vectors")
    some = file.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE_ROWS).collect()
    ids, sample = np.array([r["vec_id"] for r in some], np.int64), np.array([r["vector"] for r in some], np.int64)
    cut = cuts(sample, bits)
    d, cells = sample.shape[1], 1 << bits

    def extent(batches):
        lo, hi = np.full((d, cells), np.iinfo(np.int64).max), np.full((d, cells), np.iinfo(np.int64).min)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), d, np.int64)
                c = codes(x, cut)
                for j in range(d):
                    np.minimum.at(lo[j], c[:, j], x[:, j])
                    np.maximum.at(hi[j], c[:, j], x[:, j])
        dim, cell = np.nonzero(lo <= hi)
        yield pa.RecordBatch.from_arrays([pa.array(dim.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(lo[dim, cell]), pa.array(hi[dim, cell])], ["dim", "cell", "lo", "hi"])

    found = file.select("vector").mapInArrow(extent, "dim int, cell int, lo long, hi long").groupBy("dim", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # dimensions * cells rows
    middle, half = np.zeros((d, cells)), np.zeros((d, cells))
    for r in found:
        middle[r["dim"], r["cell"]] = (r["lo"] + r["hi"]) / 2
        half[r["dim"], r["cell"]] = (r["hi"] - r["lo"]) / 2

    def number(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in codes(matrix(b.column(1), d, np.int64), cut)], pa.binary())], ["vec_id", "cell"])

    return file, spool(file.mapInArrow(number, "vec_id long, cell binary"), "va-cells"), {"middle": middle, "half": half}, (ids, sample)


def thresholds(asked: DataFrame, sample: tuple[np.ndarray, np.ndarray], k: int = K) -> DataFrame:
    """Adds least: the query's kth score among the sampled rows (one row a vec_id, not its own), which its kth score over all rows can't fall below."""
    first = np.unique(sample[0], return_index=True)[1]
    sent = asked.sparkSession.sparkContext.broadcast((sample[0][first], sample[1][first]))

    def run(batches):
        ids, x = sent.value
        x = x.astype(np.float64).T  # exact below 2**53
        for b in batches:
            for r in range(0, b.num_rows, BLOCK):
                part = b.slice(r, BLOCK)
                q = matrix(part.column(1), x.shape[0], np.float64)
                score = q @ x
                score[part.column(0).to_numpy()[:, None] == ids[None, :]] = -np.inf
                least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(q), -np.inf)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least)], ["vec_id", "vector", "least"])

    return asked.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<bigint>, least double")


def scan(cells: DataFrame, grid: dict, queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int = K) -> DataFrame:
    """query_id, vec_id, about, slack: every row whose score may be among the k best of its query as far as its task can tell; the score lies within the row's ``slack`` of ``about``. queries: ids, the vectors as rows, and what the kth score reaches at least."""
    sent = cells.sparkSession.sparkContext.broadcast((*queries, grid))

    def run(batches):
        ids, q, least, grid = sent.value
        d = q.shape[1]
        qf = q.astype(np.float64)
        middle, half = grid["middle"].astype(np.float32), grid["half"].astype(np.float32)
        rounding = (np.abs(qf) @ (np.abs(grid["middle"]).max(1) + grid["half"].max(1))) * (d + 4) * 1.2e-7
        product, spread = qf.astype(np.float32), np.abs(qf).astype(np.float32)
        best = np.full((len(ids), k), -np.inf)  # the k largest lower bounds so far of each query
        found = []
        dims = np.arange(d)[None, :]
        for b in batches:
            for r in range(0, b.num_rows, ROWS_TOGETHER):
                part = b.slice(r, ROWS_TOGETHER)
                own = part.column(0).to_numpy()
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, d)
                x, w = middle[dims, code].T, half[dims, code].T
                for s in range(0, len(ids), BLOCK):
                    t = slice(s, s + BLOCK)
                    about, slack = (product[t] @ x).astype(np.float64), (spread[t] @ w).astype(np.float64)
                    slack += rounding[t, None]
                    about[ids[t, None] == own[None, :]] = -np.inf
                    some = min(k, len(own))
                    low = about - slack
                    top = np.concatenate((best[t], np.partition(low, len(own) - some, axis=1)[:, len(own) - some :]), axis=1)
                    best[t] = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
                    bar = np.maximum(best[t].min(1), least[t])
                    rows, cols = np.nonzero((about + slack >= bar[:, None]) & np.isfinite(about))
                    found.append((s + rows, own[cols], about[rows, cols], slack[rows, cols]))
            if sum(len(f[0]) for f in found) > 1_000_000:
                found = [_reaching(found, best, least)]
        if found:
            row, own, about, slack = _reaching(found, best, least)
            for i in range(0, len(row), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[j]]), pa.array(own[j]), pa.array(about[j]), pa.array(slack[j])], ["query_id", "vec_id", "about", "slack"])

    return cells.mapInArrow(run, "query_id long, vec_id long, about double, slack double")


def _reaching(found: list, best: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    row, own, about, slack = (np.concatenate(x) for x in zip(*found))
    keep = about + slack >= np.maximum(best.min(1), least)[row]
    return row[keep], own[keep], about[keep], slack[keep]


def fetch(reaching: DataFrame, file: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """query_id, vec_id, score: exact scores of rows (query_id, vec_id, upper), looked at by descending upper bound and for each query until the kth is certain."""
    vectors = file.select(F.col("vec_id").alias("_id"), "vector")
    queries = asked.select(F.col("vec_id").alias("_query"), F.col("vector").alias("query"))
    both = reaching.join(vectors, F.col("vec_id") == F.col("_id")).join(queries, F.col("query_id") == F.col("_query"))

    def run(batches):
        now, scores = None, []  # the query at hand, and its k best scores
        for b in batches:
            if not b.num_rows:
                continue
            ids, bound = b.column(0).to_numpy(), b.column(2).to_numpy()
            d = len(b.column(3)[0])
            x, q = matrix(b.column(3), d, np.int64), matrix(b.column(4), d, np.int64)
            keep, out = [], []
            for i in range(b.num_rows):
                if ids[i] != now:
                    now, scores = ids[i], []
                if len(scores) == k and bound[i] < scores[-1]:
                    continue  # no later bound of this query reaches the kth
                score = int(x[i] @ q[i])
                scores = sorted([*scores, score], reverse=True)[:k]
                keep.append(i)
                out.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), b.column(1).take(pa.array(keep, pa.int32())), pa.array(out, pa.int64())], ["query_id", "vec_id", "score"])

    cols = ["query_id", "vec_id", "upper", "vector", "query"]
    return both.select(*cols).repartition("query_id").sortWithinPartitions("query_id", F.col("upper").desc(), "vec_id").mapInArrow(run, "query_id long, vec_id long, score long")


def read_in_order(reaching: DataFrame, file: DataFrame, asked: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Exact scores of what two steps read (both spooled): first the 2 * k rows with the highest upper bounds of every query, then the others whose bound reaches the kth score of these."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "vec_id"))
    placed = spool(reaching.withColumn("place", place), "va-placed")
    head = spool(fetch(placed.where(F.col("place") <= 2 * k), file, asked, k), "va-read")
    kth = ranked(head, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = placed.where(F.col("place") > 2 * k).join(kth, "query_id", "left").where(F.col("upper") >= F.coalesce("kth", F.lit(float("-inf"))))
    tail = spool(fetch(rest.select("query_id", "vec_id", "upper"), file, asked, k), "va-read")
    unspool(placed)
    return head, tail


def top_k(vectors: DataFrame, is_query: Column, k: int = K, bits: int = BITS, reads: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of integer vectors (vec_id long, vector array<bigint>): each query's k highest inner products.

    ``is_query`` picks the queries; candidates are all rows but those of the query's own vec_id. Null ids and null or empty vectors take no part, vectors are compared
    with those of their length only. Rows that repeat a vec_id with another vector are candidates each, rows that repeat both count once; as a query an id counts once (with its
    smallest vector). Ties go to the smaller vec_id. An empty table gives no rows. Equal vectors beyond the k + 1 smallest ids can't be among the k best, so these are not kept.
    ``reads``, if given, gets a (queries, rows, exact rows read) for each length.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    parts = []
    for d in dimensions(vectors, "vector"):
        own = vectors.where(F.size("vector") == d)
        file, cells, grid, sample = build(first_copies(own, k + 1), bits)
        asked = spool(thresholds(own.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), sample, k), "va-queries")
        n = asked.count()
        chunks = -(-n // QUERIES_TOGETHER)
        found = []
        for c in range(chunks):
            rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect()  # about QUERIES_TOGETHER rows
            if rows:
                ids, least = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["least"] for r in rows], np.float64)
                some = scan(cells, grid, (ids, np.array([r["vector"] for r in rows], np.int64), least), k)
                # the kth largest lower bound over all tasks decides what is worth reading
                order = Window.partitionBy("query_id").orderBy((F.col("about") - F.col("slack")).desc())
                some = some.withColumn("_n", F.row_number().over(order))
                kth = F.min(F.when(F.col("_n") <= k, F.col("about") - F.col("slack"))).over(Window.partitionBy("query_id"))
                some = some.withColumn("_kth", kth).where(F.col("about") + F.col("slack") >= F.col("_kth")).select("query_id", "vec_id", (F.col("about") + F.col("slack")).alias("upper"))
                found.append(spool(some, "va-reaching"))
        if found:
            # one entry a query and id: a vec_id that stands for several vectors has all of them looked at, in the order of the best bound
            reaching = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper"))
            head, tail = read_in_order(reaching, file, asked, k)
            if reads is not None:
                reads.append((n, file.count(), head.count() + tail.count()))
            parts.append(spool(ranked(head.unionByName(tail), k), "va-best"))
            unspool(head, tail, *found)
        unspool(file, cells, asked)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts)


def op2_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    return top_k(rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
