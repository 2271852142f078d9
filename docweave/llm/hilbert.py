"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected CURVES times onto a few orthogonal directions, each time shifted, and numbered along a Hilbert curve; rows of equal numbers follow a hash. Nearness is the inner product, curves see directions
only, so rows are parted into classes of about equal length, and every class has curves of its own. A query looks at a window on each curve of each class, on both sides of its own number. Curves
are cut into units by position, pieces are runs of units, range by range along the curve; a row stands in one piece of each curve, a query goes to those pieces that its window touches. There
the rows of its window are compared through short vectors (half precision, each scaled by its own length, which is kept beside it); the best of all windows are merged as ids and ranked by the
exact measure, for which their vectors are fetched once.

A window holds at least WINDOW * rows ** POWER rows of its class (and k on each side): the measured need for a recall of 0.9 at 500 to 51,282 vectors that are spread evenly in 64
dimensions, the hardest case for any index. So the share of a table that a query meets falls as the table grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, spool, table, unspool
from .vectors import dimensions, first_copies, matrix, ranked, usable

K = 20
CURVES, DIMS, BITS = 32, 8, 4
WINDOW, POWER = 0.12, 0.84
#: Classes of length: a class spans a factor of 2 ** STEP; all rows shorter than 2 ** -(STEP * (CLASSES - 1)) of the longest are one class.
STEP, CLASSES = 0.5, 64
#: Units in half a window, and rows of a unit and of a piece at most; pieces hold eight half windows as long as that is less.
UNITS, UNIT_ROWS, PIECE_ROWS = 4, 131_072, 131_072
#: Low bits of a number on a curve that tell rows of one cell apart.
TIES = 24
#: What a window gives beyond k, and the merged best that are ranked exactly, as multiples of k; both make up for the short vectors.
MORE, RERANKED = 4, 2
SEED = 7


def hilbert(cell: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of cells (rows of small integers), by the transposed-bits method."""
    x = [cell[:, i].astype(np.int64) for i in range(cell.shape[1])]
    m = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(m):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, m):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[m - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [a ^ t for a in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(x: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """A row's number on every curve. Directions are random and orthogonal; lengths do not matter, only directions do."""
    d = x.shape[1]
    rng = np.random.default_rng([seed, d])
    x = directions(x)[0] * np.sqrt(d)
    keys = np.empty((len(x), curves), np.int64)
    m = min(dims, d)
    for c in range(curves):
        at = c % (d // m) * m
        if at == 0:  # curves of one rotation look at directions of their own
            rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        shift = rng.random(m)
        p = x @ rotation[:, at : at + m]
        u = 0.5 * (1 + np.tanh(0.7978845608 * (p + 0.044715 * p**3)))  # about the normal distribution function
        cell = np.minimum(((0.75 * u + 0.25 * shift) * (1 << bits)).astype(np.int64), (1 << bits) - 1)
        keys[:, c] = hilbert(cell, bits)
    return keys


def window_rows(n: int, k: int = K) -> int:
    """Rows on each side of a query's number that it meets on one curve of n rows."""
    return max(k, int(np.ceil(WINDOW / 2 * n**POWER)))


def layout(n: int, k: int = K) -> tuple[int, int, int]:
    """Of a class of n rows: units of a curve, units on each side of a query's own that its window holds, and units of a piece."""
    half = window_rows(n, k)
    unit = max(1, min(-(-half // UNITS), UNIT_ROWS))
    return -(-n // unit), -(-half // unit), max(1, min(8 * UNITS, PIECE_ROWS // unit))


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, curves: int = CURVES) -> DataFrame:
    """query_id, rank, vec_id, score of (vec_id long, vector array<double>): the k largest inner products found for each query.

    Candidates are all rows but those of the query's own vec_id. Null ids and null, empty, zero or non-finite vectors take no part; vectors are compared with those of their
    length only. As a query an id counts once (with its smallest vector), rows that repeat a vec_id and its vector count once. Ties go to the smaller vec_id. Vectors of any size are compared by
    direction and length apart, so some very long ones don't blur the others; those under about 2 ** -31 of the longest are one class, in which lengths are not told apart by the curves. Vectors of very many
    components are rows of their own size only. In tables of up to 2 * k rows a query finds all. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    found = None
    for d in dimensions(vectors, "vector"):
        part = _search(vectors.where(F.size("vector") == d), is_query, d, k, curves)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the logarithm (base 2) of the lengths; scaled by the largest component first, so that no square is lost."""
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / most
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / size, (np.log2(most) + np.log2(size))[:, 0]


def _search(vectors: DataFrame, is_query: Column, d: int, k: int, curves: int) -> DataFrame:
    candidates = spool(first_copies(vectors.select("vec_id", "vector"), k + 1), "curve-vectors")
    queries = spool(vectors.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), "curve-queries")

    def number(batches):
        for b in batches:
            for r in range(0, b.num_rows, 4096):
                part = b.slice(r, 4096)
                x, size = directions(matrix(part.column(1), d, np.float64))
                ids = part.column(0).to_numpy()
                tie = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIES)).astype(np.int64)
                keys = curve_keys(x, curves) << TIES | tie[:, None]
                ends = np.arange(0, keys.size + 1, curves, dtype=np.int32)
                short = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), short, pa.array(size), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["vec_id", "asks", "short", "size", "keys"])

    rows = candidates.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    rows_spooled = spool(rows.mapInArrow(number, "vec_id long, asks boolean, short binary, size double, keys array<bigint>"), "curves")
    longest = rows_spooled.where("NOT asks").agg(F.max("size")).first()[0]
    if longest is None:
        unspool(candidates, queries, rows_spooled)
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    class_ = F.least(F.floor((F.lit(longest) - F.col("size")) / STEP), F.lit(CLASSES - 1)).cast("int")
    rows = rows_spooled.withColumn("class", class_)
    sizes = {r["class"]: r["n"] for r in rows.where("NOT asks").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    plans = {c: layout(n, k) for c, n in sizes.items()}
    # cuts: every unit, from the candidates' numbers on each curve of each class; units grow in number as rows ** 0.16 up to UNIT_ROWS rows, then with the rows over UNIT_ROWS
    most = max(p[0] for p in plans.values())
    cuts = {(c, j): np.zeros(0, np.int64) for c in plans for j in range(curves)}
    if most > 1:
        at = F.array(*[F.lit(i / most) for i in range(1, most)])
        on = rows.where("NOT asks").select("class", F.posexplode("keys").alias("curve", "key"))
        for r in on.groupBy("class", "curve").agg(F.percentile_approx("key", at, F.lit(max(10_000, 8 * most))).alias("cuts")).collect():
            units = plans[r["class"]][0]
            every = np.array(r["cuts"], np.int64)
            cuts[r["class"], r["curve"]] = every[np.round(np.arange(1, units) * most / units).astype(np.int64) - 1]
    sent = vectors.sparkSession.sparkContext.broadcast((cuts, plans))

    # a row's unit: how many cuts lie at or below its number; a candidate has one in its class, a query one in each
    def place(batches):
        cuts, plans = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            keys = matrix(b.column("keys"), curves, np.int64)
            asks, own = b.column("asks").to_numpy(zero_copy_only=False), b.column("class").to_numpy()
            for c, (units, reach, piece) in plans.items():
                rows = np.flatnonzero(asks | (own == c))
                if not len(rows):
                    continue
                unit = np.stack([np.searchsorted(cuts[c, j], keys[rows, j], side="right") for j in range(curves)], axis=1).astype(np.int32)
                ends = np.arange(0, unit.size + 1, curves, dtype=np.int32)
                part = b.take(pa.array(rows))
                same = lambda x: pa.array(np.full(len(rows), x, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("asks"), part.column("short"), part.column("size"), same(c), same(units), same(reach), same(piece), pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()))],
                    ["vec_id", "asks", "short", "size", "class", "units", "reach", "piece_units", "places"],
                )

    placed = rows.mapInArrow(place, "vec_id long, asks boolean, short binary, size double, class int, units int, reach int, piece_units int, places array<int>")
    placed = placed.select("vec_id", "asks", "short", "size", "class", "units", "reach", "piece_units", F.posexplode("places").alias("curve", "unit"))
    piece = lambda unit: F.floor(unit / F.col("piece_units")).cast("int")
    touched = F.sequence(piece(F.greatest(F.col("unit") - F.col("reach"), F.lit(0))), piece(F.least(F.col("unit") + F.col("reach"), F.col("units") - 1)))
    placed = placed.withColumn("piece", F.explode(F.when(F.col("asks"), touched).otherwise(F.array(piece(F.col("unit"))))))

    def meet(batches):
        now, own, short, size, unit = None, None, None, None, None  # the piece at hand: its candidates, which come before its queries, by unit
        held: list[pa.RecordBatch] = []

        def gather():
            t = pa.Table.from_batches(held)
            held.clear()
            x = np.frombuffer(b"".join(t.column("short").to_pylist()), np.float16).reshape(-1, d)
            return t.column("vec_id").to_numpy(), x, t.column("size").to_numpy(), t.column("unit").to_numpy()

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("class", "curve", "piece", "asks")], axis=1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                part, at = b.slice(i, j - i), tuple(key[i, :3])
                if at != now:
                    now, own = at, None
                    held.clear()
                if not key[i, 3]:
                    held.append(part)
                    continue
                if held:
                    own, short, size, unit = gather()
                if own is None:
                    continue  # no candidates here
                ids, asked, reach = part.column("vec_id").to_numpy(), part.column("unit").to_numpy(), part.column("reach").to_numpy()
                q = np.frombuffer(b"".join(part.column("short").to_pylist()), np.float16).reshape(-1, d).astype(np.float32)
                lo, hi = np.searchsorted(unit, asked - reach, side="left"), np.searchsorted(unit, asked + reach, side="right")
                scale = np.exp2(size - size.max()).astype(np.float32)
                out = []
                for s in range(0, len(ids), 64):  # neighbouring queries have nearly the same window
                    t = slice(s, s + 64)
                    a, z = int(lo[t].min()), int(hi[t].max())
                    if a >= z:
                        continue
                    about = (q[t] @ short[a:z].astype(np.float32).T) * scale[a:z]
                    col = np.arange(a, z)[None, :]
                    about[(col < lo[t, None]) | (col >= hi[t, None]) | (ids[t, None] == own[None, a:z])] = -np.inf
                    some = min(k + MORE, z - a)
                    top = np.argpartition(-about, some - 1, axis=1)[:, :some]
                    score = np.take_along_axis(about, top, 1)
                    r, c = np.nonzero(np.isfinite(score))
                    # a score as sign and logarithm: lengths of any size
                    s_ = score[r, c].astype(np.float64)
                    out.append((ids[s + r], own[a + top[r, c]], np.sign(s_), np.log2(np.maximum(np.abs(s_), 1e-300)) + size.max()))
                if out:
                    one, two, sign, log = (np.concatenate(z) for z in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(sign * np.exp2(np.clip(log - longest, -900, 900)))], ["query_id", "vec_id", "score"])

    columns = ["class", "curve", "piece", "asks", "unit", "reach", "vec_id", "size", "short"]
    by = ["class", "curve", "piece"]
    met = placed.select(*columns).repartition(*by).sortWithinPartitions(*by, "asks", "unit", "vec_id")
    met = met.mapInArrow(meet, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # ids are merged; the best of them are ranked by the exact measure
    best = ranked(met, RERANKED * k).select("query_id", "vec_id")
    best = best.join(candidates.select(F.col("vec_id").alias("_id"), "vector"), F.col("vec_id") == F.col("_id"))
    best = best.join(queries.select(F.col("vec_id").alias("_query"), F.col("vector").alias("query")), F.col("query_id") == F.col("_query"))
    score = F.aggregate(F.zip_with("vector", "query", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    out = best.select("query_id", "vec_id", score.alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = spool(ranked(out, k), "curve-best")
    unspool(candidates, queries, rows_spooled)
    return out


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return neighbours(rows, F.col("vec_id") % 20 == 0)
