import pytest
from helpers import rows
from pyspark.sql import functions as F

from lodeline.operators import callgraph as G
from lodeline.operators import search as Q


@pytest.fixture(scope="module")
def calls(spark):
    data = [
        ("a.cs", "A", "M", 3, "Run", "SameClass"), ("a.cs", "A", "M", 4, "Write", "System.Console"), ("a.cs", "A", "M", 4, "Go", "store"),
        ("b.cs", "B", "N", 1, "Run", "Unknown"), ("b.cs", "C", "N", 2, "Run", "x"), ("c.cs", "D", "P", 9, "Other", "BaseClass"),
    ]
    return spark.createDataFrame(data, "path string, caller_class string, caller_method string, line int, callee_method string, callee_class string")


def test_callers_skip_the_own_file(spark, calls):
    target = spark.createDataFrame([("a.cs", "Run"), ("zz.cs", "Other")], "target_path string, target_method string")
    got = G.callers(calls, target).select("target_method", "path", "caller_class", "line")
    assert rows(got) == [("Other", "c.cs", "D", 9), ("Run", "b.cs", "B", 1), ("Run", "b.cs", "C", 2)]


def test_callees(spark, calls):
    target = spark.createDataFrame([("a.cs", "A", "M")], "path string, class_name string, method_name string")
    assert rows(G.callees(calls, target).select("callee_method")) == [("Go",), ("Run",), ("Write",)]


def test_totals(spark, calls):
    target = spark.createDataFrame([("a.cs", "A", "Run"), ("a.cs", "A", "M"), ("z.cs", "Z", "No")], "path string, class_name string, method_name string")
    assert rows(G.graph_totals(calls, target)) == [("a.cs", "A", "M", 0, 3, 0), ("a.cs", "A", "Run", 2, 0, 1), ("z.cs", "Z", "No", 0, 0, 0)]


def test_categories(calls):
    assert rows(G.call_categories(calls)) == [("external", 3), ("same", 1), ("system", 2)]
    assert G.external_calls(calls).count() == 3


def test_class_counts_and_hints(calls):
    got = G.with_class_count(calls, calls, "caller_class")
    hint = G.caller_hint(F.col("caller_class"), F.col("is_single_class"))
    assert rows(got.select("path", "classes_in_file", hint).distinct()) == [
        ("a.cs", 1, ""), ("b.cs", 2, " (className: `B`)"), ("b.cs", 2, " (className: `C`)"), ("c.cs", 1, ""),
    ]


METHODS = [("a", "A", "M", 5), ("a", "A", "M", 2), ("a", "B", "M", 1), ("a", "A", "N", 7)]


def test_find_target(spark):
    methods = spark.createDataFrame(METHODS, "path string, class_name string, method_name string, line int")
    asked = [("a", "M", None), ("a", "M", "A"), ("a", "M", "Z"), ("a", "N", None), ("a", "N", "Z"), ("a", "X", None)]
    targets = spark.createDataFrame(asked, "path string, method_name string, class_name string")
    got = {(r.method_name, r.wanted_class): (r.class_name, r.line, r.status) for r in G.find_target(methods, targets).collect()}
    assert got[("M", "")][2] == "class_required"
    assert got[("M", "A")] == ("A", 2, "ok")
    assert got[("M", "Z")][2] == "class_not_found"
    # with one class there is nothing to choose
    assert got[("N", "")] == ("A", 7, "ok") and got[("N", "Z")] == ("A", 7, "ok")
    assert got[("X", "")][2] == "not_found"


def test_lookup(spark):
    methods = spark.createDataFrame(METHODS, "path string, class_name string, method_name string, line int")
    asked = spark.createDataFrame([("a", "M", None), ("a", "M", "A"), ("a", "N", None), ("a", "Q", None)], "path string, name string, class_name string")
    got = Q.lookup_many(methods, asked).select("method_name", "wanted_class", "class_name", "line", "ambiguous")
    assert rows(got) == [
        ("M", "", "A", 2, True), ("M", "", "A", 5, True), ("M", "", "B", 1, True), ("M", "A", "A", 2, False), ("M", "A", "A", 5, False),
        ("N", "", "A", 7, False),
    ]
    assert rows(Q.not_found(methods, asked).select("name")) == [("Q",)]
    assert rows(Q.available_names(methods, "path")) == [("a", "M"), ("a", "N")]


def test_call_graph_pages_callers_only(calls):
    got = G.call_graph(calls, "a.cs", "A", "Run", page=2, size=1)
    assert rows(got) == [("caller", "b.cs", "C", "N", 2)]
    got = G.call_graph(calls, "a.cs", "A", "M")
    assert rows(got.select("direction", "class_name")) == [("callee", "SameClass"), ("callee", "System.Console"), ("callee", "store")]


def test_dependency_edges(spark):
    params = spark.createDataFrame([("p", "A", "IB"), ("p", "A", "IB"), ("p", "A", "C")], "project string, type_name string, type string")
    assert rows(G.dependency_edges(params)) == [("p", "A", "C"), ("p", "A", "IB")]
