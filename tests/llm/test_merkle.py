"""Merkle proofs: the query against SQL, trees of every size against a plain builder, odd rows."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from docweave.llm import merkle

from ..conftest import assert_same

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def up(nodes):
    return [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def way(nodes, i):
    """Siblings left and right of node i, level by level, and the digest at the end."""
    out = []
    while len(nodes) > 1:
        a = i // 16 * 16
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])))
        nodes, i = up(nodes), i // 16
    return out, nodes[0]


def plain(rows):
    """(doc_id, leaf) -> (subroot, root, siblings) of every row."""
    by = lambda r: (r[1] is not None, (r[1] or "").encode())
    trees = [sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for _, x in groupby(sorted(rows, key=by), key=by)]
    leaves = [[leaf(r) for r in t] for t in trees]
    subroots = [way(x, 0)[1] for x in leaves]
    out = []
    for s, t in enumerate(trees):
        above, root = way(subroots, s)
        for i, r in enumerate(t):
            own, sub = way(leaves[s], i)
            out.append((r[0], leaves[s][i], sub, root, tuple(own + above)))
    return sorted(out, key=repr)


def found(spark, rows):
    got = merkle.proofs(spark.createDataFrame(rows, SCHEMA), F.lit(False))
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["segments"])) for r in got.collect()), key=repr)


def test_query_equals_sql(spark, small):
    assert_same(merkle.op13_merkle(spark, small), merkle.OP13_SQL, small)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1, 256), (257, 4097), tuple([2] * 20)])
def test_trees_of_all_sizes(spark, sizes):
    rows = [(i, f"s{s:02d}", "en", i, f"text {i}") for s, n in enumerate(sizes) for i in range(n)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, "a", None, None, None), (1, "a", "en", 3, "one"), (1, "a", "en", 3, "one"), (None, "a", "en", 1, ""), (2, None, "de", 4, "Größe"), (3, "", "fr", 0, "x" * 300_000), (4, "é", "es", -5, "-"), (5, "Z", None, 1, "0:")]
    got = found(spark, rows)
    assert got == plain(rows)
    assert all(merkle_fold(r) == r[3] for r in got)
    wide = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA + ", tree long, place long, digest string, leaf string")
    assert merkle.proofs(wide, F.lit(False)).count() == len(rows)
    assert merkle.proofs(wide.limit(0), F.lit(False)).count() == 0


def merkle_fold(r):
    acc = r[1]
    for left, right in r[4]:
        acc = H(left, acc, right)
    return acc


def test_tampering_shows(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", i, None if i % 7 == 0 else f"Text {i}" if i % 2 else f"text {i}") for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in merkle.op13_merkle(spark, str(tmp_path)).collect()}
    want = {r[0]: r for r in plain(rows)}
    for r in rows:
        tampered = zlib.crc32(str(r[0]).encode()) % 5 == 0
        changed = leaf((*r[:4], r[4].lower())) if tampered and r[4] else leaf(r)
        segments = want[r[0]][4]
        g = got[r[0]]
        assert g["proof_sha256"] == H(*[a + b for a, b in segments]) and g["folded_root"] == merkle_fold((0, changed, 0, 0, segments))
        assert g["verified"] == (changed == leaf(r)) and g["root"] == want[r[0]][3]
    assert 0 < sum(not g["verified"] for g in got.values()) < len(rows)
