"""Search by postings finds what a scan finds, also after updates."""

import random

import pytest

from lodeline.operators import postings as P


@pytest.fixture(scope="module")
def made():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcÄé中 \n.") for _ in range(draw.randint(0, 12)))
    texts = [(i, " ".join(word() for _ in range(draw.randint(0, 6)))) for i in range(80)]
    return texts + [(80, None), (None, "abc"), (81, ""), (82, "a"), (83, "AB"), (84, "ab\x00c")]


QUERIES = ["a", "B", "ab", "BC", "abc", "Ä", "ä中", "c a", ". \n", "中", "aaaaaaaa", "zzz", "", None, "ab", "b\x00c"]


def by_scan(texts):
    return sorted({(q, k) for q in QUERIES if q for k, t in texts if k is not None and t is not None and q.lower() in t.lower()})


def test_search_agrees_with_a_scan(spark, made):
    texts = spark.createDataFrame(made, "key int, body string").selectExpr("*", "'clash' AS gram", "1 AS n_texts")
    queries = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    posted = P.postings(texts, "key", "body")
    counts = P.gram_counts(posted)
    for rarest in (1, 4):
        found = P.search_texts(queries, texts, posted, counts, "key", "body", rarest).collect()
        assert sorted(map(tuple, found)) == by_scan(made)
    shares = {r["query"]: (r["candidates"], r["share"]) for r in P.share_read(queries, texts, posted, counts, "key").collect()}
    assert shares["zzz"] == (0, 0.0) and 0 < shares["b\x00c"][1] < 1


def test_updated_postings_are_those_of_the_new_texts(spark, made):
    schema = "key int, body string"
    changed = [(1, "new abc"), (2, None), (200, "ab"), (3, made[3][1])]
    new = [t for t in made if t[0] not in {1, 2, 3}] + [c for c in changed if c[1] is not None]
    posted = P.update_postings(P.postings(spark.createDataFrame(made, schema), "key", "body"), spark.createDataFrame(changed, schema), "key", "body")
    want = P.postings(spark.createDataFrame(new, schema), "key", "body")
    assert sorted(map(tuple, posted.collect())) == sorted(map(tuple, want.collect()))
    empty = spark.createDataFrame([], schema)
    assert P.postings(empty, "key", "body").collect() == []
