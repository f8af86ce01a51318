from helpers import rows, values
from pyspark.sql import functions as F

from lodeline.operators import inventory as I

FILES = "project string, path string, content string"


def test_file_info_and_enrichment(spark):
    files = spark.createDataFrame([("p", "A.cs", "a\nb\n"), ("p", "e.txt", "")], FILES)
    asked = spark.createDataFrame([("A.cs",), ("e.txt",), ("no.cs",)], "path string")
    info = I.file_info(files, asked)
    assert rows(info.drop("modified_at")) == [("A.cs", True, 2, 4, ".cs"), ("e.txt", True, 0, 0, ".txt"), ("no.cs", False, -1, -1, "")]
    results = spark.createDataFrame([("a.CS", True), ("e.txt", False), ("no.cs", True)], "path string, success boolean")
    assert sorted(map(tuple, I.enrich_results(results, info).collect()), key=str) == [
        ("a.CS", True, 2, 4), ("e.txt", False, None, None), ("no.cs", True, None, None),
    ]


def test_collapse(spark):
    many = [("p", f"big/{i:03}.cs", "") for i in range(51)] + [("p", f"fit/{i:03}.cs", "") for i in range(50)] + [("p", "top.cs", "")]
    got = I.collapse_large_folders(spark.createDataFrame(many, FILES))
    assert rows(got.groupBy("folder", "collapsed", "files").count()) == [("", False, 1, 1), ("big", True, 51, 1), ("fit", False, 50, 50)]


def test_tree(spark):
    files = spark.createDataFrame(
        [("p", "a/b/x.cs", 100, 5), ("p", "a/y.cs", 20000, 7), ("p", "z.cs", 4, 1)], "project string, path string, size_bytes bigint, line_count int"
    )
    got = I.folder_tree(files).select("folder", "depth", "files", "size_bytes", "line_count", "large_files", "size")
    assert rows(got) == [
        ("", 0, 3, 20104, 13, 1, "19.6KB"), ("a", 1, 2, 20100, 12, 1, "19.6KB"), ("a/b", 2, 1, 100, 5, 0, "100B"),
    ]


def test_last_sibling(spark):
    files = spark.createDataFrame([("p", "a/1", ""), ("p", "a/2", ""), ("p", "b/1", "")], FILES)
    assert rows(I.last_siblings(files).where("is_last").select("path")) == [("a/2",), ("b/1",)]


def test_listing_is_one_level_deep(spark):
    files = spark.createDataFrame([("p", "a/Cart.cs", ""), ("p", "a/b/Cart.cs", ""), ("p", "a/Other.cs", "")], FILES)
    assert rows(I.folder_listing(files, "a/", " cart ").select("path")) == [("a/Cart.cs",)]
    assert I.folder_listing(files, "a", " ").count() == 2


def test_profile(spark):
    files = spark.createDataFrame(
        [
            ("p", "b.csproj", "<TargetFramework>net9.0</TargetFramework>"), ("p", "a/a.csproj", "<x/>"), ("p", "bin/c.csproj", ""),
            ("p", "x.slnx", ""), ("p", "sub/y.sln", ""), ("q", "readme.md", ""), ("r", "s.sln", ""), ("r", "s.slnx", ""),
        ],
        FILES,
    )
    got = I.project_profile(files)
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("p", True, 2, "", True), ("q", False, 0, None, False), ("r", True, 0, None, True),
    ]
    assert rows(I.solution_files(files)) == [("p", "x.slnx", 1), ("r", "s.sln", 0), ("r", "s.slnx", 1)]


def test_framework_ignores_case(spark):
    texts = ["<targetframework>net8.0</TARGETFRAMEWORK>", "<TargetFrameworks>a;b</TargetFrameworks>"]
    assert values(spark, texts, "t string", I.target_framework(F.col("t"))) == ["net8.0", None]


def test_deepest_first(spark):
    df = spark.createDataFrame([("a",), ("a/b/c",), ("a\\b",), ("/d/",)], "path string")
    assert [r.path for r in I.deepest_first(df).collect()] == ["a/b/c", "a\\b", "/d/", "a"]
