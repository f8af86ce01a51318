"""Components, cycles, depth, reach and levels against plain Python on random graphs."""

import random

import pytest

from lodeline.operators import callgraph as G
from lodeline.operators import depgraph as D


def reach_of(edges):
    nodes = {n for e in edges for n in e}
    found = {n: {b for a, b in edges if a == n} for n in nodes}
    while True:
        wider = {n: s | {m for k in s for m in found[k]} for n, s in found.items()}
        if wider == found:
            return found
        found = wider


def frame(spark, edges):
    return spark.createDataFrame(edges, "from_type string, to_type string")


def brute_cycles(edges, reach):
    out = {}
    for n in reach:
        mates = {m for m in reach if m == n or (m in reach[n] and n in reach[m])}
        if n == min(mates) and (len(mates) > 1 or n in reach[n]):
            paths = [[n]]
            while not any((p[-1], n) in edges for p in paths):
                paths = [p + [m] for p in paths for m in mates if (p[-1], m) in edges and m not in p]
            best = min(p for p in paths if (p[-1], n) in edges)
            out[n] = (len(mates), len(best), " -> ".join(best))
    return out


def brute_depth(edges, reach):
    comp = {n: min([m for m in reach if m in reach[n] and n in reach[m]] + [n]) for n in reach}
    below = {c: {comp[b] for a, b in edges if comp[a] == c and comp[b] != c} for c in comp.values()}
    depth = lambda c: 1 + max(map(depth, below[c])) if below[c] else 0
    return {n: depth(comp[n]) for n in reach}


@pytest.mark.parametrize("seed,nodes,count,hub", [(1, 14, 16, 100_000), (2, 12, 30, 2)])
def test_against_brute_force(spark, seed, nodes, count, hub):
    draw = random.Random(seed)
    edges = {(f"n{draw.randrange(nodes)}", f"n{draw.randrange(nodes)}") for _ in range(count)}
    edges |= {("hub", f"n{i}") for i in range(0, nodes, 2)} | {("n1", "hub")}
    reach = reach_of(edges)
    graph = D.Condensed(frame(spark, [*edges, *list(edges)[:3], (None, "x"), ("x", None)]), hub)
    want = brute_cycles(edges, reach)
    assert {r["cycle"]: (r["members"], r["length"], r["path"]) for r in graph.cycles().collect()} == want
    assert {r["node"] for r in graph.cycle_members().collect()} == {n for n in reach if n in reach[n]}
    assert {r["node"]: r["depth"] for r in graph.depths().collect()} == brute_depth(edges, reach)
    assert {r["node"]: r["reached"] for r in graph.reach().collect()} == {n: len(s - {n}) for n, s in reach.items()}


def test_no_edges(spark):
    graph = D.Condensed(frame(spark, [(None, "a")]))
    for rows in (graph.cycles(), graph.cycle_members(), graph.depths(), graph.reach()):
        assert rows.collect() == []
    empty = spark.createDataFrame([], "from_type string, to_type string, source string")
    assert {r["measure"]: r["value"] for r in D.statistics(empty).collect()} == {"total_classes": 0, "total_dependencies": 0, "mean_dependencies": 0}


def test_levels_end_in_circles_and_are_paged(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("y", "x"), ("z", "z")]
    calls = spark.createDataFrame(edges, "caller string, callee string")
    targets = spark.createDataFrame([("b",), ("z",), ("none",), (None,)], "target string")
    found = {(r["target"], r["method"]): r["level"] for r in G.call_levels(calls, targets, 9).collect()}
    assert found == {("b", "a"): 1, ("b", "x"): 1, ("b", "c"): 2, ("b", "y"): 2, ("b", "b"): 3, ("z", "z"): 1}
    down = G.call_levels(calls, targets, 1, "callees")
    assert {(r["target"], r["method"]) for r in down.collect()} == {("b", "c"), ("z", "z")}
    pages = G.level_pages(G.call_levels(calls, targets, 2), 1).collect()
    assert {(r["method"], r["level"], r["page"], r["total_pages"]) for r in pages if r["target"] == "b"} == {
        ("a", 1, 1, 2), ("x", 1, 2, 2), ("c", 2, 1, 2), ("y", 2, 2, 2)}


def test_calls_of_a_hot_name_are_dealt_to_parts(spark):
    rows = [(f"f{i % 7}", "C", "M", i, "Hot" if i % 3 else f"P{i}", "X") for i in range(300)] + [(None, "C", "M", 1, "Hot", "X"), ("f9", "C", "M", None, None, "X")]
    calls = spark.createDataFrame(rows, "path string, caller_class string, caller_method string, line int, callee_method string, callee_class string")
    targets = spark.createDataFrame([("f1", "Hot"), ("f2", "Hot"), ("f1", "Hot"), ("q", "P3"), (None, "P6")], "target_path string, target_method string")
    plain = sorted(map(tuple, G.callers(calls, targets).collect()), key=str)
    split = sorted(map(tuple, G.callers(calls, targets, hot_calls=10).collect()), key=str)
    assert plain == split and len(plain) > 300
