"""Vectors in parts with a centre and a radius, and an exact nearest-neighbour search that skips parts by the triangle inequality."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import shared_dir

#: Vectors that a part should hold, the most parts, and the folders that a large part's rows are dealt to.
PART_ROWS, MOST_PARTS, PART_FILES = 4096, 1024, 8
#: Queries that go out together.
QUERIES = 4096
#: Angles and products are compared with this much room; scores are rounded to nine places.
ROOM, PLACES = 1e-7, 9


@dataclass
class Store:
    """path: the vectors by part (chunk_id, vector of length 1, part); centres: unit vectors; radii: the largest angle of a part's vectors to its centre; sizes: rows of each part."""

    vectors: DataFrame
    path: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def delete(self) -> None:
        spark = self.vectors.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bare(vectors: DataFrame) -> Column:
    return F.transform("embedding", lambda x: x.cast("double"))


def build_store(vectors: DataFrame, part_rows: int | None = None) -> Store | None:
    """Of (chunk_id long, embedding; all of one length). Centres are rows with the smallest hashes; every row joins the nearest one, and a part's radius is measured over all its rows. Null vectors take no part; None if nothing is left."""
    spark = vectors.sparkSession
    rows = vectors.where("embedding IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", _bare(vectors).alias("embedding"))
    n = rows.count()
    if not n:
        return None
    parts = min(MOST_PARTS, max(1, -(-n // (part_rows or PART_ROWS))))
    some = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(parts).collect()  # MOST_PARTS rows at most
    centres = _unit(np.array([r["embedding"] for r in some], np.float64))
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        c = sent.value
        for b in batches:
            for r in range(0, b.num_rows, 4096):
                part = b.slice(r, 4096)
                x = _unit(_matrix(part.column(1)))
                near = x @ c.T
                own = near.argmax(axis=1).astype(np.int32)
                angle = np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))
                ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel())), pa.array(own), pa.array(angle)], ["chunk_id", "vector", "part", "angle"])

    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    placed = rows.mapInArrow(assign, "chunk_id long, vector array<double>, part int, angle double")
    placed.repartition("part", F.pmod(F.xxhash64("chunk_id"), F.lit(PART_FILES))).write.partitionBy("part").parquet(path)
    stored = spark.read.schema("chunk_id long, vector array<double>, angle double, part int").parquet(path)
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in stored.groupBy("part").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[r["part"]], sizes[r["part"]] = r["radius"], r["n"]
    return Store(stored.select("chunk_id", "vector", "part"), path, centres, radii, sizes)


class _Best:
    """The k best of every query so far (ties: smaller id)."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (rows) with some rows of the table (columns)."""
        bar = self.least[who]
        if score.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
        row, col = np.nonzero(score >= bar[:, None])  # all that tie with the kth
        self.parts.append((who[row], ids[col], score[row, col]))
        self.held += len(row)
        if self.held > 4 * self.k * len(self.least) + 500_000:
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, own, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((own, -score, row))
        row, own, score = row[order], own[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = place < self.k
        last = place == self.k - 1
        self.least[row[last]] = score[last]
        self.parts = [(row[keep], own[keep], score[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def _search(store: Store, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    """query_id, chunk_id, score: of each task the k best of every query among the parts that it wants (queries by parts). Parts that no query wants are not read; a task keeps one list a query, whatever it reads."""
    sent = store.vectors.sparkSession.sparkContext.broadcast((ids, q, wanted))
    parts = np.flatnonzero(wanted.any(axis=0)).tolist()

    def run(batches):
        ids, q, wanted = sent.value
        best = _Best(len(ids), k)
        for b in batches:
            part_of = b.column(2).to_numpy()
            order = np.lexsort((b.column(0).to_numpy(), part_of))
            for rows in np.split(order, np.flatnonzero(np.diff(part_of[order])) + 1):
                who = np.flatnonzero(wanted[:, part_of[rows[0]]]) if len(rows) else []
                for r in range(0, len(rows) if len(who) else 0, 4096):
                    some = b.take(pa.array(rows[r : r + 4096]))
                    x, at = _matrix(some.column(1)).T, some.column(0).to_numpy()
                    for s in range(0, len(who), 512):
                        best.add(who[s : s + 512], np.round(q[who[s : s + 512]] @ x, PLACES), at)
        row, own, score = best.done()
        for i in range(0, len(row), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[j]]), pa.array(own[j]), pa.array(score[j])], ["query_id", "chunk_id", "score"])

    read = store.vectors.where(F.col("part").isin(parts))
    return read.mapInArrow(run, "query_id long, chunk_id long, score double")


def nearest(store: Store, query_vectors: DataFrame, k: int, counts: dict | None = None) -> DataFrame | None:
    """query_id, chunk_id, score (cosine, rounded), rank: the k nearest rows of every query (query_id long, embedding). None without queries.

    A slice of queries first searches the parts nearest to each until they hold k rows; its kth score is a bound. A part whose nearest possible row (the angle to its centre less its radius) can't reach that bound is skipped.
    ``counts``, if given, gets the (query, part) pairs that were searched and all there are.
    """
    spark = store.vectors.sparkSession
    queries = query_vectors.where("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", _bare(query_vectors).alias("embedding"))
    slices = max(1, -(-queries.count() // QUERIES))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    out = None
    for i in range(slices):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i).collect()  # about QUERIES rows
        if not rows:
            continue
        ids, q = np.array([r["query_id"] for r in rows], np.int64), _unit(np.array([r["embedding"] for r in rows], np.float64))
        angle = np.arccos(np.clip(q @ store.centres.T, -1, 1))
        closest = np.argsort(angle, axis=1)
        enough = np.cumsum(store.sizes[closest], axis=1)
        first = np.zeros(angle.shape, bool)
        np.put_along_axis(first, closest, np.concatenate((np.zeros((len(ids), 1), np.int64), enough[:, :-1]), axis=1) < k, axis=1)
        first &= store.sizes[None, :] > 0
        found = _search(store, ids, q, first, k)
        searched = first
        if not first.all():
            ranked = found.withColumn("rank", F.row_number().over(order))
            kth = {r["query_id"]: r["score"] for r in ranked.where(F.col("rank") == k).select("query_id", "score").collect()}
            bar = np.array([kth.get(x, -np.inf) for x in ids.tolist()])
            most = np.cos(np.maximum(angle - store.radii[None, :] - ROOM, 0.0))
            rest = ~first & (most + ROOM >= bar[:, None]) & (store.sizes[None, :] > 0)
            if rest.any():
                found = found.unionByName(_search(store, ids, q, rest, k))
                searched = first | rest
        if counts is not None:
            counts["searched"] = counts.get("searched", 0) + int(searched.sum())
            counts["all"] = counts.get("all", 0) + searched.size
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)
    return out
