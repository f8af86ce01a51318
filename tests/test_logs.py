from helpers import rows
from pyspark.sql import functions as F

from lodeline.operators import logs as L

LINES = [
    r"src\A.cs(12,5): error CS0246: The type [x] is missing [/app/P.csproj]",
    "  /src/A.cs(12,5): ERROR CS0246: repeated  ",
    "src/B.cs(1,2): Warning CA10: plain",
    "src/B.cs(99999999999,2): warning CA11: far",
    "Build started (1,2)",
    "error CS0001: no place",
    "",
]


def parsed(spark):
    log = spark.createDataFrame(list(enumerate(LINES)), "seq int, line string")
    return L.parse_diagnostics(log, "seq")


def test_parse(spark):
    assert rows(parsed(spark)) == [
        # everything from the first bracket on counts as the project suffix
        (0, "error", "CS0246", "src/A.cs", 12, 5, "The type"),
        (1, "error", "CS0246", "src/A.cs", 12, 5, "repeated"),
        (2, "warning", "CA10", "src/B.cs", 1, 2, "plain"),
        (3, "warning", "CA11", "src/B.cs", -1, 2, "far"),
    ]


def test_first_of_each_counts(spark):
    got = L.dedupe_diagnostics(parsed(spark), "seq")
    assert rows(got.select("seq", "code")) == [(0, "CS0246"), (2, "CA10"), (3, "CA11")]
    assert rows(L.severity_filter(got).select("seq")) == [(0,)]
    assert L.severity_filter(got, include_warnings=True).count() == 3


def test_summary(spark):
    once = L.dedupe_diagnostics(parsed(spark), "seq")
    assert tuple(L.build_summary(once).first()) == (1, 2, False, "Build FAILED — 1 error(s), 2 warning(s)")
    clean = once.where("severity = 'warning'")
    assert tuple(L.build_summary(clean).first()) == (0, 2, True, "Build succeeded — 0 errors, 2 warning(s)")


def test_package_logs(spark):
    logs = spark.createDataFrame([(1, "ok\nWarning: x"), (2, "a\n ERROR: b \nwarn: c\nerror and warn"), (3, "Unrecognized thing")], "id int, output string")
    assert dict(rows(logs.select("id", L.package_log_ok(F.col("output"))))) == {1: True, 2: False, 3: False}
    assert rows(L.parse_package_log(logs, "id")) == [(2, 2, "ERROR: b", "error"), (2, 3, "warn: c", "warning"), (2, 4, "error and warn", "error")]
