import pytest
from helpers import rows
from pyspark.sql import functions as F

from lodeline.operators import ordered as O
from lodeline.operators import search as Q

MEMBERS = [
    ("p", "a.cs", None, "Class", "RingStore", 1), ("p", "a.cs", "RingStore", "Method", "GetRing", 5),
    ("p", "b.cs", "X", "Attribute", "RingAttribute", 2), ("q", "c.cs", "Y", "Property", "Size", 9), ("q", "c.cs", "Y", "Field", "ring", 3),
]
BODIES = [("p", "a.cs", "RingStore", "GetRing", "line one\nreturn THE ring: x\n the ring: y", 5), ("q", "c.cs", "Y", "Other", "nothing", 20)]


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(MEMBERS, "project string, path string, parent string, member_type string, name string, line bigint")


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame(BODIES, "project string, path string, class_name string, method_name string, full_code string, line bigint")


@pytest.mark.parametrize("query,want", [("ring", False), ("a b", True), ("a:", True), ('say "x', True), ("x" * 15, False), ("x" * 16, True)])
def test_content_queries(query, want):
    assert Q.is_content_query(query) is want


def test_hits_and_rank(members):
    got = Q.rank(Q.member_hits(members, "ring")).select("name", "score").collect()
    assert [tuple(r) for r in got] == [("ring", 1.0), ("Ring", 0.9), ("GetRing", 0.8), ("RingStore", 0.8)]
    got = Q.rank(Q.member_hits(members, "ring", scorer="tiered")).select("name", "score").collect()
    assert [tuple(r) for r in got] == [("Ring", 1000.0), ("ring", 1000.0), ("RingStore", 500.0), ("GetRing", 200.0)]


def test_member_types(members):
    assert rows(Q.member_hits(members, "ring", "Method").select("name")) == [("GetRing",)]
    with pytest.raises(ValueError):
        Q.member_type_filter(members, "Namespace")
    with pytest.raises(ValueError):
        Q.member_hits(members, "ring", scorer="other")


def test_body_hits_point_at_the_first_line(bodies):
    assert rows(Q.body_hits(bodies, "the ring:").select("name", "line", "score")) == [("GetRing", 6, 0.8)]
    assert rows(Q.body_hits(bodies, "the ring:", case_sensitive=True).select("line")) == [(7,)]
    assert rows(Q.body_hits(bodies, "one\nreturn").select("line")) == [(5,)]


def test_a_method_may_appear_twice(spark, members, bodies):
    named = spark.createDataFrame([("p", "a.cs", "C", "Method", "the ring: go", 5)], members.schema)
    hits = Q.all_hits(named, bodies, "the ring:")
    assert hits.count() == 2
    assert Q.all_hits(named, bodies, "the ring:", member_type="Field").count() == 0


def test_search_page_and_summary(members, bodies):
    page = Q.search(members, bodies, "ring", page=9, size=3).collect()
    assert [(r.name, r.page, r.total_pages, r.total_results) for r in page] == [("RingStore", 2, 2, 4)]
    assert Q.search(members, bodies, "zzz").count() == 0
    got = Q.search_summary(members, bodies, "ring", size=3).first()
    assert tuple(got) == (4, 3, 2, 2, 1, True)
    assert tuple(Q.search_summary(members, bodies, "zzz", project="q").first()) == (0, 1, 1, 1, 1, False)


def test_counts_per_project(members):
    got = Q.hits_by_project_type(Q.member_hits(members, "ring"))
    assert rows(got.select("project", "type_rank", "member_type", "hits", "project_hits")) == [
        ("p", 1, "Class", 1, 3), ("p", 3, "Method", 1, 3), ("p", 8, "Attribute", 1, 3), ("q", 5, "Field", 1, 1),
    ]


def test_pages_make_up_the_whole(spark):
    df = spark.range(103).select((F.col("id") % 7).alias("k"), "id")
    order = [F.desc("k"), F.asc("id")]
    whole = [r.id for r in df.orderBy(*order).collect()]
    pages = [[r.id for r in O.page_clamped(df, order, p, 20).orderBy(*order).collect()] for p in range(1, 7)]
    assert sum(pages, []) == whole
    assert O.page_clamped(df, order, 0, 20).first().page == 1


def test_page_rules(spark):
    df, order = spark.range(101), [F.asc("id")]
    one = O.page_unclamped(df, order, 1, 500).first()
    assert (one.total_pages, one.has_next, one.has_previous) == (3, True, False)
    assert O.page_unclamped(df, order, 4, 50).isEmpty()
    assert O.page_diagnostics(df, order, 1, 500).count() == 101
    assert O.page_diagnostics(df, order, 9, 50).isEmpty()
    assert O.page_diagnostics(df, order, 1, 0).count() == 1
    assert O.page_clamped(df, order, 1, 60, largest=50).count() == 50
    with pytest.raises(ValueError):
        O.page_clamped(df, order, 1, 500, clamp=False)


@pytest.mark.parametrize("hot", [0, 1])
def test_row_numbers_and_far_pages(spark, hot, monkeypatch):
    # with hot = 1 one key holds most rows
    key = F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 5) if hot else F.col("id") % 11
    df = spark.range(0, 5000, 1, 7).select(key.alias("k"), F.xxhash64("id").alias("h"), "id")
    order = [F.asc("k"), F.asc("h")]
    want = [r.id for r in df.orderBy(*order).collect()]
    got = O.with_row_number(df, order, "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001))
    assert [r.id for r in got] == want
    for near in (1000, 10):
        monkeypatch.setattr(O, "NEAR_ROWS", near)
        page = O.take_page(df, order, 7, 100).orderBy(*order).collect()
        assert [r.id for r in page] == want[600:700]
        last = O.page_clamped(df, order, 999, 60)
        assert [r.id for r in last.orderBy(*order).collect()] == want[4980:] and last.first().total_results == 5000
    # neighbours agree with a window
    from pyspark.sql import Window

    paired = O.with_next(df, ["k"], [F.asc("h")], {"next_id": "id"})
    lead = df.withColumn("next_id", F.lead("id").over(Window.partitionBy("k").orderBy("h")))
    assert paired.select("k", "h", "id", "next_id").exceptAll(lead).isEmpty()
    assert paired.count() == 5000


def test_page_numbers(spark):
    got = O.with_page_number(spark.range(10), [F.desc("id")], 4).orderBy("id").collect()
    assert [r.page for r in got] == [3, 3, 2, 2, 2, 2, 1, 1, 1, 1]


def test_language_order(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "name string")
    assert [r.name for r in O.sort_by_name(df, "name").collect()] == ["A", "B", "a", "b"]
    assert [r.name for r in O.sort_by_name(df, "name", collation="UNICODE").collect()] == ["a", "A", "b", "B"]
