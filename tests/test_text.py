import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from lodeline.functions import payload as PL
from lodeline.functions import text as X
from lodeline.functions.expiry import expires_soon, format_ttl, ttl_class
from lodeline.operators import lines as L


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1536, 1280, 1048576, 1073741824, 1099511627776]
    assert values(spark, sizes, "n bigint", X.format_size(F.col("n"))) == [
        "0B", "1023B", "1KB", "1.5KB", "1.3KB", "1MB", "1GB", "1024GB",
    ]


def test_large_counts_bytes(spark):
    bodies = ["x" * 15360, "x" * 15361, "é" * 7681]
    assert values(spark, bodies, "t string", X.is_large(F.col("t"))) == [False, True, True]


def test_line_counts(spark):
    texts = ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n"]
    got = values(spark, texts, "t string", X.split_line_count(F.col("t")), X.read_line_count(F.col("t")))
    assert got == [(1, 0), (1, 1), (2, 1), (2, 2), (3, 2), (2, 1)]


def test_lines(spark):
    files = spark.createDataFrame([("f", "a\r\nHit b\n\nhit"), ("g", "none")], "path string, content string")
    assert rows(L.explode_lines(files, "path")) == [("f", 1, "a"), ("f", 2, "Hit b"), ("f", 3, ""), ("f", 4, "hit"), ("g", 1, "none")]
    assert rows(L.grep(files, "HIT", "path")) == [("f", 2, "Hit b", "   2 | Hit b"), ("f", 4, "hit", "   4 | hit")]
    assert rows(L.grep_counts(files, "hit", "path")) == [("f", 2, 4)]
    assert rows(L.line_range(files, 3, 99, "path")) == [("f", 4, 4, 3, ""), ("f", 4, 4, 4, "hit")]


@pytest.mark.parametrize("args", [(1, None), (None, 2), (0, 3), (3, 2), (1, 2, "q")])
def test_bad_ranges(args):
    with pytest.raises(ValueError):
        L.check_range(*args)


def test_slice_body(spark):
    text = "x\nvoid A()\n{\n  b();\n}\ny"
    parts = L.slice_body(F.col("t"), F.col("a"), F.col("b"))
    got = values(spark, [(text, 2, 5), (text, 1, 2), (text, 5, 99)], "t string, a int, b int", parts["full_code"], parts["body"])
    assert got == [("void A()\n{\n  b();\n}", "  b();\n}"), ("x\nvoid A()", ""), ("}\ny", "")]


def test_markers(spark):
    inputs = [
        ("class A { }", ".cs"), ("var x = builder.Services.AddSingleton(); app.Use(1);", ".cs"),
        ('{"Logging": {}, "ConnectionStrings": 1}', ".json"), ("class A", ".txt"), ("[Route] await x", ".cs"),
    ]
    marks = X.content_markers(F.col("t"), F.col("e"))
    got = values(spark, inputs, "t string, e string", marks["has_types"], marks["top_level"], marks["is_configuration"], marks["patterns"])
    assert got == [
        (True, False, False, ""),
        (False, True, False, "Top-level statements (modern .NET); Dependency injection registration; Middleware pipeline"),
        (False, False, True, "Database connection strings; Logging configuration"),
        (False, False, False, ""),
        (False, True, False, "Top-level statements (modern .NET); API routes/controllers"),
    ]


def test_truncation(spark):
    body, over = X.truncate_body(F.col("t"), 256)
    texts = ["a" * 256, "a" * 257, "é" * 200, "x" + "é" * 200, "ab" + "中" * 100, "abc" + "😀" * 80, "😀" * 64, ""]
    got = values(spark, texts, "t string", body, over)
    assert got == [(t.encode()[:256].decode(errors="ignore"), len(t.encode()) > 256) for t in texts]
    with pytest.raises(ValueError):
        X.truncate_body(F.col("t"), 255)


def test_zones(spark):
    shown = X.to_zone(F.col("t").cast("timestamp_ntz"), "America/New_York")
    got = values(spark, ["2024-07-01 12:00:00", "2024-01-01 00:00:00"], "t string", *shown.values())
    assert got == [
        ("2024-07-01 12:00:00", "2024-07-01 08:00:00", 1719835200), ("2024-01-01 00:00:00", "2023-12-31 19:00:00", 1704067200),
    ]


def test_captures(spark):
    got = values(spark, ["a1 b2", "none", ""], "t string", X.captures(F.col("t"), r"([a-z])(\d)", 2))
    assert got == [[["a", "1"], ["b", "2"]], [], []]


HOUR = 3600000


def test_remaining_life(spark):
    left = [None, -1, 0, 59 * 60000, 6 * HOUR - 1, 6 * HOUR, 48 * HOUR, 49 * HOUR]
    ms = F.col("m")
    got = values(spark, left, "m bigint", ttl_class(ms), format_ttl(ms), F.coalesce(expires_soon(ms), F.lit(False)))
    assert got == [
        ("none", "No expiry", False), ("red", "Expired", False), ("red", "Expired", True), ("red", "59m", True),
        ("red", "5h 59m", True), ("orange", "6h 0m", False), ("green", "2d 0h", False), ("green", "2d 1h", False),
    ]


JSON, TEXT = "application/json", "text/plain"
PAYLOADS = [
    (JSON, ""), ("image/png", "xx"), (JSON, "[1,2,3]"), (JSON, '{"b":1,"a":{"c":2}}'), (JSON, "7"), (JSON, "{oops\n"),
    (TEXT, "a\nb\nc"), ("application/xml", "<a/>"), (JSON, "null"),
]


def test_payload_shapes(spark):
    got = values(spark, PAYLOADS, "c string, b string", PL.payload_shape(F.col("c"), F.col("b")))
    assert got == ["empty", "binary", "array", "object", "text", "text", "text", "text", "text"]


def test_payload_stats(spark):
    stats = PL.payload_stats(F.col("c"), F.col("b"), 256, 2)
    names = ["array_count", "top_level_keys", "line_count", "shown", "truncated"]
    got = values(spark, PAYLOADS[:8], "c string, b string", *[stats[n] for n in names])
    assert got == [
        (-1, "", -1, -1, False), (-1, "", -1, -1, True), (3, "", -1, 2, True), (-1, "b,a", -1, -1, False),
        (-1, "", 1, -1, False), (-1, "", 2, -1, False), (-1, "", 3, 2, False), (-1, "", 1, 1, False),
    ]


def test_previews(spark):
    assert values(spark, ["a\nb\nc", "a"], "t string", PL.preview_lines(F.col("t"), 2)) == ["a\nb", "a"]
    assert values(spark, ['[1,{"a":2},"x"]', "{}"], "t string", PL.preview_items(F.col("t"), 2)) == [["1", '{"a":2}'], None]
    for k in (0, 51):
        with pytest.raises(ValueError):
            PL.preview_lines(F.col("t"), k)


def test_headers(spark):
    headers = {"Content-Type": "a", "AUTHORIZATION": "b", "etag": "c"}
    df = spark.createDataFrame([(headers,)], "h map<string,string>")
    assert df.select(PL.allowlist_map(F.col("h"))).first()[0] == {"Content-Type": "a", "etag": "c"}
