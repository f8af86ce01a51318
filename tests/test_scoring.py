import random

from helpers import values
from pyspark.sql import functions as F

from lodeline.functions import scoring as S

NAMES = [
    "pss", "PssReader", "ProjectSkeletonService", "MyPssFile", "xpssx", "pXsYs", "nothing", "", None, "ÉtatPss", "PSs",
]


def reference_tier(name, query):
    """Row by row, in plain Python."""
    if not name or not query:
        return 0.0
    n, q = name.lower(), query.lower()
    if n == q:
        return 1000.0
    if n.startswith(q):
        return 500.0
    if "".join(c for c in name if c.isupper()).lower().startswith(q):
        return 300.0
    words, word = [], ""
    for c in name:
        if "A" <= c <= "Z" and word:
            words.append(word)
            word = ""
        word += c
    words.append(word)
    if any(w.lower().startswith(q) for w in words):
        return 200.0
    if " " in query and all(t.lower() in n for t in query.split(" ") if t):
        return 150.0
    if q in n:
        return 100.0
    at, last, gap = 0, -1, 0
    for i, c in enumerate(n):
        if at < len(q) and c == q[at]:
            gap += i - last - 1 if last >= 0 else 0
            last, at = i, at + 1
    if at < len(q):
        return 0.0
    return float(max(1, 50 - int((gap / (len(q) - 1) if len(q) > 1 else 0) * 5)))


def test_each_tier(spark):
    got = values(spark, NAMES, "name string", S.tier_score(F.col("name"), "pss"))
    assert got == [1000.0, 500.0, 300.0, 200.0, 100.0, 45.0, 0.0, 0.0, 0.0, 200.0, 1000.0]


def test_tiers_match_plain_python(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abABsS é") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(300)]
    for query in ["a", "ab", "bS", "s a", "ABs", "sab"]:
        got = values(spark, names, "name string", S.tier_score(F.col("name"), query))
        want = [reference_tier(n, query) for n in names]
        assert got == want, [(n, g, w) for n, g, w in zip(names, got, want) if g != w][:5]


def test_empty_query_scores_nothing(spark):
    assert values(spark, ["a"], "name string", S.tier_score(F.col("name"), "")) == [0.0]


def test_word_before_tokens_and_tokens_before_substring(spark):
    names = ["SearchGloballyAsync", "GlobalSearch", "a search global b"]
    assert values(spark, names, "name string", S.tier_score(F.col("name"), "search global")) == [150.0, 150.0, 200.0][:2] + [150.0]


def test_case_sensitive(spark):
    names = ["Ring", "ring", "SmallRing", "smallring", "RING"]
    got = values(spark, names, "name string", S.tier_score(F.col("name"), "Ring", True))
    assert got == [1000.0, 0.0, 200.0, 0.0, 0.0]
    assert values(spark, ["aBc"], "name string", S.word_prefix(F.col("name"), "aB", True)) == [False]


def test_special_characters_are_literal(spark):
    names = ["a.b", "axb", "a*b(c"]
    assert values(spark, names, "name string", S.tier_score(F.col("name"), "a.b")) == [1000.0, 0.0, 0.0]
    assert values(spark, names, "name string", S.tier_score(F.col("name"), "*(")) == [0.0, 0.0, 45.0]
    assert values(spark, ["a^]b"], "name string", S.subsequence_score(F.col("name"), "^]")) == [50.0]


def test_simple_scores(spark):
    names = ["pss", "MyPssFile", "ProjectSkeletonService", "PssX"]
    assert values(spark, names, "name string", S.simple_score(F.col("name"), "pss")) == [1.0, 0.8, 0.7, 0.8]
    # initials ignore case even in a case-sensitive search
    assert values(spark, names, "name string", S.simple_score(F.col("name"), "pss", True)) == [1.0, 0.0, 0.7, 0.0]


def test_attribute_names(spark):
    names = ["HttpPostAttribute", "AttributeUsageAttribute", "Key"]
    col = F.col("name")
    assert values(spark, names, "name string", S.attribute_name(col, "tiered")) == ["HttpPost", "AttributeUsage", "Key"]
    assert values(spark, names, "name string", S.attribute_name(col, "simple")) == ["HttpPost", "Usage", "Key"]
    assert values(spark, names, "name string", S.attribute_score(col, "post")) == [0.9, 0.0, 0.0]
