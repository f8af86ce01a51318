import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from lodeline.functions import policy as P
from lodeline.operators import policy as A

PATHS = {
    "src/a.cs": ("ok", "ok"),
    "bin/a.cs": ("blocked_dir", "blocked_dir"),
    "src\\OBJ\\a.cs": ("blocked_dir", "blocked_dir"),
    "src/appsettings.json": ("blocked_name", "ok"),
    "AppSettings.Production.JSON": ("blocked_name", "ok"),
    "x.pem": ("extension_not_allowed", "ok"),
    "my-secret.txt": ("blocked_pattern:*secret*", "blocked_pattern:*secret*"),
    "a.private.cs": ("blocked_pattern:*.private.*", "blocked_pattern:*.private.*"),
    "Tokenizer.cs": ("blocked_pattern:*token*", "blocked_pattern:*token*"),
    "Dockerfile": ("ok", "ok"),
    "a.json": ("extension_not_allowed", "ok"),
    "private/a.cs": ("sensitive_keyword", "ok"),
    "../x.cs": ("ok", "path_traversal"),
    "a/../b.cs": ("ok", "ok"),
    "a/../../b.cs": ("ok", "path_traversal"),
    "docs/read.MD": ("ok", "ok"),
}


def test_first_failing_rule(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    read = {r.path: r.reason for r in A.access_verdict(df).collect()}
    write = {r.path: r.reason for r in A.write_verdict(df).collect()}
    assert {p: (read[p], write[p]) for p in PATHS} == PATHS
    assert all(r.allowed == (r.reason == "ok") for r in A.access_verdict(df).collect())


def test_globs(spark):
    names = ["a.cs", "A.CS", "ab.cs", "x.a.cs.y", None]
    assert values(spark, names, "n string", P.glob_match(F.col("n"), "?.cs")) == [True, True, False, False, None]
    assert values(spark, names, "n string", P.loose_glob(F.col("n"), "*.cs")) == [True, True, True, True, None]
    assert values(spark, names, "n string", P.loose_glob(F.col("n"), "a.cs")) == [True, True, False, False, None]


def test_exact_entries_are_no_patterns(spark):
    assert values(spark, ["*.pem", "x.pem"], "n string", P.blocked_file_name(F.col("n"))) == [True, False]


def test_excluded_dirs(spark):
    paths = ["a/Bin/b.cs", "a/binary/b.cs", "a\\.git\\c"]
    assert values(spark, paths, "p string", P.not_excluded_dir(F.col("p"), P.INDEX_DIRS)) == [False, True, False]
    assert values(spark, paths, "p string", P.not_excluded_dir(F.col("p"), P.INDEX_DIRS, True)) == [True, True, False]


def test_tests_are_left_out(spark):
    df = spark.createDataFrame([("x/Tests/a.cs",), ("x\\Test\\a.cs",), ("x/Testing/a.cs",)], "path string")
    assert rows(A.exclude_tests(df)) == [("x/Testing/a.cs",)]
    assert A.exclude_tests(df, include_tests=True).count() == 3


def test_identifiers(spark):
    assert values(spark, ["A.b-c_1", "a b", "x" * 201, ""], "t string", P.valid_id(F.col("t"))) == [True, False, False, False]
    versions = ["1.0", "1.2.3.4-rc.1", "1", "1.0.0.0.0", "v1.0"]
    assert values(spark, versions, "t string", P.valid_version(F.col("t"))) == [True, True, False, False, False]
    assert values(spark, ["C:\\a b/c_d.e", "a;b"], "t string", P.valid_path(F.col("t"))) == [True, False]


def test_environment_reasons(spark):
    inputs = [
        ("", "http://a", "None", None), ("n", " ", "None", None), ("n", "ftp://a", "None", None), ("n", "a/b", "None", None),
        ("n", "http://a", "Bearer", " "), ("n", "https://a", "Basic", None), (" n", " https://a/x ", "Bearer", "t"),
    ]
    got = values(
        spark, inputs, "n string, u string, a string, s string",
        P.environment_reason(F.col("n"), F.col("u"), F.col("a"), F.col("s")),
    )
    assert got == [
        "name required", "url required", "url must be http or https", "url must be http or https", "token required",
        "username required", None,
    ]


def test_labels(spark):
    assert values(spark, [".cs", ".YML", ".x"], "e string", P.file_type_label(F.col("e"))) == [
        "C# Source File", "YAML Configuration", "Unknown",
    ]


@pytest.mark.parametrize("cutoff", ["2026-01-17T00:00:00Z", "1768608000"])
def test_changed_since_is_strict(spark, cutoff):
    df = spark.sql(
        "select * from values (1, timestamp_ntz'2026-01-17 00:00:00'), (2, timestamp_ntz'2026-01-17 00:00:01') t(id, modified_at)"
    )
    assert [r.id for r in A.changed_since(df, cutoff).collect()] == [2]


def test_unreadable_cutoff_fails(spark):
    df = spark.sql("select 1 id, timestamp_ntz'2026-01-17 00:00:00' modified_at")
    with pytest.raises(Exception, match="cannot read cutoff"):
        A.changed_since(df, "soon").collect()


def test_projects(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "project string, n int")
    registry = spark.createDataFrame([("a", True), ("b", False)], "name string, enabled boolean")
    assert A.project_filter(df, "*").count() == 2
    assert A.project_filter(df, "zzz").count() == 0
    assert [r.project for r in A.enabled_only(df, registry).collect()] == ["a"]
