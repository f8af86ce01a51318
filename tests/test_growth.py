"""What must not be read twice, sent to every task or passed by the driver, seen in the plans."""

import pytest

from lodeline.operators import callgraph as G
from lodeline.operators import depgraph as D
from lodeline.operators import postings as P
from lodeline.operators import structure as S
from lodeline.plans import structure_queries as Q


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    text = "class A { void F() { G(); } int H(List<int> a) { return a; } }"
    rows = [("p", "a.cs", text), ("p", "b.cs", None), (None, "c.cs", text)]
    at = str(tmp_path_factory.mktemp("files") / "rows")
    spark.createDataFrame(rows, "project string, path string, content string").write.parquet(at)
    return spark.read.parquet(at)  # a table whose size the planner knows


def test_patterns_of_members_run_in_one_step(files):
    plan = optimized(S.extract_methods(files))
    assert len([line for line in plan.splitlines() if S.CTOR in line]) == 1


def test_texts_are_not_sent_to_every_task(files):
    bodies = S.extract_bodies(files)
    assert "BroadcastHashJoin" not in executed(bodies) and "SortMergeJoin" in executed(bodies)
    assert sorted(r["key"] for r in bodies.collect()) == ["A::F::1", "A::H::1"]


def test_members_read_before_give_the_same_rows(files):
    read = S.members(files).cache()
    for operator in (S.extract_types, S.extract_methods, S.extract_bodies, S.member_index):
        assert sorted(map(str, operator(files, read).collect())) == sorted(map(str, operator(files).collect()))


def test_members_are_read_once(monkeypatch, spark, tiny):
    read = S.members
    for name in ("file_index", "source_search"):
        seen = []
        with monkeypatch.context() as m:
            m.setattr(S, "members", lambda files: seen.append(1) or read(files))
            getattr(Q, name)(spark, tiny)
        assert len(seen) == 1


def test_calls_are_stored_before_they_are_searched(monkeypatch, spark, tiny):
    seen = []
    monkeypatch.setattr(Q.G, "call_graph", lambda calls, *_: seen.append(optimized(calls)))
    Q.source_call_graph(spark, tiny)
    assert "Generate" not in seen[0]


def test_rounds_over_a_graph_broadcast_nothing(monkeypatch, spark):
    plans, keep = [], D.stored
    monkeypatch.setattr(D, "stored", lambda frame: plans.append(executed(frame)) or keep(frame))
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a"), ("d", "f")]
    graph = D.Condensed(spark.createDataFrame(edges, "from_type string, to_type string"), 1)
    plans += [executed(f) for f in (graph.cycles(), graph.cycle_members(), graph.depths(), graph.reach())]
    # Row numbers join a table of one row per range.
    assert [p for p in plans if "BroadcastHashJoin" in p and "_range" not in p] == []


def test_levels_read_stored_edges(monkeypatch, spark):
    seen, split = [], G.split_edges
    monkeypatch.setattr(G, "split_edges", lambda edges, *more: seen.append(optimized(edges)) or split(edges, *more))
    calls = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "caller string, callee string")
    found = G.call_levels(calls, spark.createDataFrame([("c",)], "target string"), 2)
    assert sorted(map(tuple, found.collect())) == [("c", "a", 2), ("c", "b", 1)]
    assert "Aggregate" not in seen[0]


def test_postings_of_different_keys_are_not_shuffled(spark):
    schema = "key int, body string"
    assert "Exchange" not in executed(P.postings(spark.createDataFrame([(1, "abc"), (2, "abc"), (None, "x")], schema), "key", "body"))
    twice = P.postings(spark.createDataFrame([(1, "abc"), (1, "abcd"), (2, "abc"), (2, None)], schema), "key", "body").collect()
    assert sorted(map(tuple, twice)) == sorted({(g, 1) for g in ("abc", "bcd", "bc\0", "c\0\0", "cd\0", "d\0\0")} | {(g, 2) for g in ("abc", "bc\0", "c\0\0")})
