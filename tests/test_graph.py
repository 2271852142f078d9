"""Closures, components and change impact against plain searches, rounds counted."""

import random
from collections import deque

import pytest

from docweave.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges) or [("", "")], "source string, target string").limit(len(edges) or 0)


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node string")


def depths(edges, start):
    into = {}
    for s, t in edges:
        into.setdefault(t, []).append(s)
    out, queue = {x: 0 for x in start}, deque(start)
    while queue:
        x = queue.popleft()
        for y in into.get(x, ()):
            if y not in out:
                out[y] = out[x] + 1
                queue.append(y)
    return out


def components(edges):
    ahead = {}
    for s, t in edges:
        ahead.setdefault(s, set()).add(t)
    everyone = {x for e in edges for x in e}

    def reach(x):
        seen, queue = set(), deque(ahead.get(x, ()))
        while queue:
            y = queue.popleft()
            if y not in seen:
                seen.add(y)
                queue.extend(ahead.get(y, ()))
        return seen

    to = {x: reach(x) for x in everyone}
    return {x: min(y for y in to[x] if x in to[y]) for x in everyone if x in to[x]}


def random_graph(seed):
    rng = random.Random(seed)
    n = rng.choice([12, 25, 40])
    names = [f"n{i:02d}" for i in range(n)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(int(n * rng.choice([0.7, 1.1, 1.6])))}
    chain = [f"c{i:02d}" for i in range(10)]
    edges |= set(zip(chain[1:], chain)) | {(chain[0], rng.choice(names)), (rng.choice(names), chain[-1])}
    ring = [f"r{i}" for i in range(5)]
    edges |= set(zip(ring, ring[1:] + ring[:1])) | {("hang", "r2"), ("r3", "tail"), ("tail", "tail2")}
    return edges


@pytest.mark.parametrize("seed", range(1, 4))
def test_closures_and_components_of_random_graphs(spark, seed):
    edges = random_graph(seed)
    start = ["c00", "n00", "r1", "alone"]
    got = {r["node"]: r["depth"] for r in graph.impact_closure(frame(spark, edges), nodes(spark, [*start, None, "c00"])).collect()}
    assert got == depths(edges, start)
    got = graph.dependency_cycles(frame(spark, edges)).collect()
    assert {r["node"]: r["component"] for r in got} == components(edges) and len(got) == len(components(edges))


def test_long_ways_take_few_rounds(spark):
    chain = {(f"{i + 1:05d}", f"{i:05d}") for i in range(4096)}
    rounds = []
    got = {r["node"]: r["depth"] for r in graph.impact_closure(frame(spark, chain), nodes(spark, ["00000"]), rounds).collect()}
    assert got == {f"{i:05d}": i for i in range(4097)} and len(rounds) <= 14
    rounds = []
    assert graph.dependency_cycles(frame(spark, chain), rounds).count() == 0 and len(rounds) <= 14
    rounds = []
    got = {r["node"]: r["component"] for r in graph.dependency_cycles(frame(spark, chain | {("00000", "04096")}), rounds).collect()}
    assert got == {f"{i:05d}": "00000" for i in range(4097)} and len(rounds) <= 16


def test_no_edges(spark):
    none = frame(spark, set())
    assert [tuple(r) for r in graph.impact_closure(none, nodes(spark, ["a"])).collect()] == [("a", 0)]
    assert graph.dependency_cycles(none).count() == 0
    assert graph.impact_closure(frame(spark, {("a", "b")}), nodes(spark, ["a"]).limit(0)).count() == 0
    assert graph.impact_closure(spark.createDataFrame([("a", None), (None, "b"), ("a", "a"), ("c", "a")], "source string, target string"), nodes(spark, ["a"])).count() == 2


def test_changes_walk_together(spark):
    """More changes than a word has bits; every node of every change is found, and nodes take a row a word."""
    edges = random_graph(7) | {(f"c{i:02d}", f"n{i:02d}") for i in range(10)}
    names = sorted({x for e in edges for x in e})
    ops = [(i, "source_update", names[i % len(names)]) for i in range(150)] + [(0, "page_edit", names[5]), (200, "odd", None)]
    df = spark.createDataFrame(ops, "change_id long, type string, target_id string")
    want = {}
    for c, _, t in ops:
        if t is not None:
            want.setdefault(c, set()).update(depths(edges, [t]))
    got = {}
    for r in graph.affected_nodes(df, frame(spark, edges)).collect():
        assert r["node"] not in got.setdefault(r["change_id"], set())
        got[r["change_id"]].add(r["node"])
    assert got == want
    unknown = spark.createDataFrame([(0,), (0,), (9,)], "change_id long")
    impact = {r["change_id"]: r for r in graph.change_impact(df, frame(spark, edges), unknown).collect()}
    assert {c: r["affected"] for c, r in impact.items()} == {c: len(want.get(c, ())) for c in [*range(150), 200]}
    assert {c for c, r in impact.items() if r["blockers"] == ["DEPENDENCY_UNKNOWN"] and r["unknown_dependencies"]} == {0, 9} and impact[1]["blockers"] == []


def test_reached_bits_send_no_table_through_the_driver(spark):
    """Three rounds over 20,000 nodes: what stages send to the driver stays far below the tables."""
    sc = spark.sparkContext
    sent = lambda: sum(s.resultSize() for s in (lambda a: [a.apply(i) for i in range(a.size())])(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())))
    edges = spark.range(60_000).selectExpr("concat('node-', id % 20000 + 20000 * cast(id / 20000 as int)) AS source", "concat('node-', id % 20000 + 20000 * (cast(id / 20000 as int) - 1)) AS target")
    ops = spark.range(20_000).selectExpr("id % 5 AS change_id", "concat('node-', id) AS target_id")
    before = sent()
    state, _ = graph.reached_bits(ops, edges)
    assert state.count() == 60_000 and sent() - before < 1_500_000


def test_cycles_of_a_large_tree_are_found_after_trims(spark):
    """What no edge leads to is in no table of edges, and a binary tree goes by half in a round without a fold."""
    sc = spark.sparkContext
    written = lambda: sum(s.outputRecords() for s in (lambda a: [a.apply(i) for i in range(a.size())])(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())))
    tree = {(f"s{k}", f"s{k // 2}") for k in range(2, 256)} | {("s1", "ring1"), ("ring1", "ring2"), ("ring2", "ring3"), ("ring3", "ring1"), ("ring2", "out"), ("loop", "loop"), ("loop", "out"), ("in", "loop")}
    leaves = spark.range(20_000).selectExpr("concat('p', id) AS source", "concat('s', 1 + id % 255) AS target")
    edges, rounds, before = frame(spark, tree).unionByName(leaves).unionByName(leaves), [], written()
    got = {r["node"]: r["component"] for r in graph.dependency_cycles(edges, rounds).collect()}
    assert got == {"ring1": "ring1", "ring2": "ring1", "ring3": "ring1", "loop": "loop"} == components(tree)
    assert written() - before < 20_000 and rounds.count("trim") <= 9 and rounds.count("jump") <= 4
