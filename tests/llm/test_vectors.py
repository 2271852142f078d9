"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import hilbert, va_file

from ..conftest import DATA, assert_same


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<double>")


def brute(rows, is_query, k):
    out = {}
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v]
    for q, x in ok:
        if is_query(q):
            s = sorted(((-float(x @ y), c) for c, y in ok if c != q and len(y) == len(x)))[:k]
            out[q] = [(c, -v) for v, c in s]
    return out


def test_op2_equals_sql(spark, small):
    assert_same(va_file.op2_va_file(spark, small), va_file.OP2_SQL, small)


def test_exact_search_with_ties_copies_and_gaps(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-30, 30, 6).tolist()) for i in range(300)] + [(1000 + i, [5, 5, 5, 5, 5, 5]) for i in range(200)] + [(2000 + i, rng.integers(-9, 9, 3).tolist()) for i in range(5)]
    rows += [(None, [1, 1, 1, 1, 1, 1]), (3000, None), (3001, [])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>")
    want = brute(rows, lambda q: q % 20 == 0, 7)
    monkeypatch.setattr(va_file, "QUERIES_TOGETHER", 9)  # several chunks
    for bits in (1, 3, 8):
        got = {}
        for r in va_file.top_k(df, F.col("vec_id") % 20 == 0, 7, bits).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], float(r["score"])))
        assert got == {k: v for k, v in want.items() if v}
    assert va_file.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, []), (None, [1.0, 1.0]), (8, [0.25, 0.0]), (1, [0.5, 0.5])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hilbert.neighbours(frame(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 8, 0.25)]
    assert hilbert.neighbours(frame(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    e = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e["embedding"].values).astype(float), e["vec_id"].values
    q = np.flatnonzero(ids % 20 == 0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :20]
    got = {}
    for r in hilbert.op4_hilbert(spark, f"{DATA}/{sf}").collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    assert np.mean([len(got[ids[i]].keys() & set(ids[t])) / 20 for i, t in zip(q, top)]) >= 0.9
    at = {k: i for i, k in enumerate(ids)}
    for k, found in got.items():
        ranks = sorted(found.items(), key=lambda f: f[1][0])
        assert len(found) == 20 and k not in found and [f[0] for f in ranks] == sorted(found, key=lambda v: (-found[v][1], v))
        assert all(abs(score - x[at[k]] @ x[at[v]]) < 1e-12 for v, (_, score) in found.items())


def test_hilbert_numbers_are_a_path():
    for m, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * m, indexing="ij"), -1).reshape(-1, m)
        key = hilbert.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(side**m))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_equal_vectors_are_split_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "UNIT_ROWS", 2)
    monkeypatch.setattr(hilbert, "PIECE_ROWS", 4)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(100 + i, [float(i), 1.0, -1.0]) for i in range(10)]
    got = [(r["rank"], r["vec_id"]) for r in hilbert.neighbours(frame(spark, rows), F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_cells_are_coarser_than_values_and_few_rows_are_read(spark):
    """Cells stand for several values in every dimension, all values of a row lie in its cells' extents, and a query reads less than 5 % of the table exactly."""
    e = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = e.select("vec_id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("long")).alias("vector"))
    file, cells, grid, _ = va_file.build(rows)
    x = {r["vec_id"]: np.array(r["vector"]) for r in file.collect()}
    code = {r["vec_id"]: np.frombuffer(r["cell"], np.uint8) for r in cells.collect()}
    ids = sorted(x)
    values, numbers = np.stack([x[i] for i in ids]), np.stack([code[i] for i in ids])
    for j in range(values.shape[1]):
        assert len(np.unique(numbers[:, j])) < len(np.unique(values[:, j])) and grid["half"][j].max() > 0
    dims = np.arange(values.shape[1])
    assert (np.abs(values - grid["middle"][dims, numbers]) <= grid["half"][dims, numbers]).all()
    reads = []
    va_file.top_k(rows, F.col("vec_id") % 20 == 0, reads=reads)
    queries, n, read = reads[0]
    assert queries == 100 and n == 2000 and 20 <= read / queries < 0.05 * n


def lengths(kind, n, rng):
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "log-normal":
        return x * rng.lognormal(0, 1, (n, 1))
    if kind == "one huge":
        x[777] *= 1e9
    if kind == "extreme":  # squares of these are no numbers
        x[:5] *= 1e200
        x[5:10] *= 1e-200
    return x


@pytest.mark.parametrize("kind", ["log-normal", "one huge", "extreme"])
def test_recall_of_unequal_lengths(spark, kind):
    x = lengths(kind, 1500, np.random.default_rng(3))
    got = {}
    for r in hilbert.neighbours(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    q = np.arange(0, 1500, 20)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :20]
    assert np.mean([len(got[i] & set(t.tolist())) / 20 for i, t in zip(q.tolist(), top)]) >= 0.9


def test_pieces_by_position_give_the_same_windows(spark, monkeypatch):
    """However curves are cut into pieces, a query meets its whole window."""
    x = lengths("unit", 600, np.random.default_rng(4))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    ask = lambda: {(r["query_id"], r["vec_id"]) for r in hilbert.neighbours(df, F.col("vec_id") % 20 == 0, k=5, curves=4).collect()}
    whole = ask()
    monkeypatch.setattr(hilbert, "PIECE_ROWS", 1)
    assert ask() == whole
