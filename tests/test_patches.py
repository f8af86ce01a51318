import random

import pytest
from helpers import rows

from lodeline.operators import patches as P

PATCH = "path string, seq bigint, action string, start_line int, end_line int, content string"
FILE = "path string, content string"


def patches(spark, *data):
    return spark.createDataFrame([("f", i, *d) for i, d in enumerate(data)], PATCH)


@pytest.fixture(scope="module")
def file(spark):
    return spark.createDataFrame([("f", "1\n2\n3\n4\n5\n")], FILE)


def applied(spark, file, *data):
    out = P.apply_patches(patches(spark, *data), file).orderBy("line_no").collect()
    assert [r.line_no for r in out] == list(range(1, len(out) + 1))
    return [r.line for r in out]


def test_validation(spark, file):
    data = {
        ("patch", 0, 1, "x"): "start out of range", ("patch", 6, 6, "x"): "start out of range", ("delete", 3, 2, None): "end before start",
        ("patch", 5, 6, "x"): "end out of range", ("patch", 1, 1, None): "content required", ("patch", 1, 1, ""): "ok",
        ("insert", 0, 0, "x"): "ok", ("insert", 5, 0, "x"): "ok", ("insert", 6, 6, "x"): "start out of range", ("insert", -1, 0, "x"): "start out of range",
        ("insert", 1, 1, None): "content required", ("append", 0, 0, None): "ok", ("delete", 1, 5, None): "ok",
    }
    got = P.validate_patches(patches(spark, *data), file).orderBy("seq").collect()
    assert [r.reason for r in got] == list(data.values())
    other = spark.createDataFrame([("g", 1, "append", 0, 0, "x")], PATCH)
    assert P.validate_patches(other, file).first().reason == "file not found"


def conflicts(spark, *data):
    return rows(P.patch_conflicts(patches(spark, *data)).select("seq", "next_seq"))


def test_conflicts(spark):
    assert conflicts(spark, ("patch", 1, 2, "x"), ("patch", 3, 4, "x")) == []
    assert conflicts(spark, ("patch", 1, 2, "x"), ("patch", 2, 4, "x")) == [(0, 1)]
    # an insert after line 2 stands at 3
    assert conflicts(spark, ("patch", 1, 2, "x"), ("insert", 2, 2, "x")) == []
    assert conflicts(spark, ("patch", 1, 3, "x"), ("insert", 2, 2, "x")) == [(0, 1)]
    assert conflicts(spark, ("insert", 2, 2, "x"), ("patch", 3, 3, "x")) == [(0, 1)]
    assert conflicts(spark, ("insert", 2, 2, "x"), ("insert", 2, 2, "y")) == [(0, 1)]
    assert conflicts(spark, ("append", 0, 0, "x"), ("append", 0, 0, "y")) == []


def test_apply(spark, file):
    assert applied(spark, file, ("patch", 2, 3, "a\nb\nc")) == ["1", "a", "b", "c", "4", "5"]
    assert applied(spark, file, ("insert", 0, 0, "top"), ("delete", 5, 5, None)) == ["top", "1", "2", "3", "4"]
    assert applied(spark, file, ("append", 0, 0, "x\r\ny"), ("append", 0, 0, "z")) == ["1", "2", "3", "4", "5", "x", "y", "z"]
    # a patched line and an insert after it: the insert follows all new lines
    for order in (0, 1):
        both = [("patch", 2, 2, "a\nb"), ("insert", 2, 2, "in")]
        assert applied(spark, file, *(both if order else both[::-1])) == ["1", "a", "b", "in", "3", "4", "5"]


def plain(lines, edits):
    """The same edits with plain lists, from the bottom up."""
    for action, start, end, content in sorted((e for e in edits if e[0] != "append"), key=lambda e: (-e[1], e[0] == "patch")):
        new = content.split("\n") if content is not None else []
        if action == "insert":
            lines[start:start] = new
        else:
            lines[start - 1 : end] = new
    for e in edits:
        if e[0] == "append":
            lines += e[3].split("\n")
    return lines


def test_apply_matches_plain_lists(spark):
    rng = random.Random(11)
    files, edits, want = [], [], {}
    for f in range(12):
        n = rng.randint(1, 30)
        lines = [f"{f}.{i}" for i in range(n)]
        files.append((f"f{f}", "\n".join(lines)))
        mine, line = [], 1
        while line <= n:
            end = min(n, line + rng.randint(0, 2))
            kind = rng.choice(["patch", "delete", "insert", "skip"])
            content = None if kind == "delete" else f"n{line}\nm"
            if kind == "insert":
                mine.append(("insert", line, line, content))
                line += 2
            else:
                if kind != "skip":
                    mine.append((kind, line, end, content))
                line = end + 1
        mine.append(("append", 0, 0, "end"))
        want[f"f{f}"] = plain(lines, mine)
        edits += [(f"f{f}", i, *e) for i, e in enumerate(mine)]
    rng.shuffle(edits)
    table, source = spark.createDataFrame(edits, PATCH), spark.createDataFrame(files, FILE)
    assert P.accepted_patches(table, source).count() == len(edits)
    got = {}
    for r in P.apply_patches(table, source).orderBy("path", "line_no").collect():
        got.setdefault(r.path, []).append(r.line)
    assert got == want


def test_one_file_with_all_lines_and_patches(spark):
    n = 40_000
    edits = [("delete", 1, 9_000, None)]
    edits += [("patch", i, i + 1, f"p{i}\nq{i}") if i % 20 else ("insert", i, i, f"i{i}") for i in range(9_010, n - 1_000, 10)]
    edits += [("append", 0, 0, f"end{i}") for i in range(2_000)]
    table = spark.createDataFrame([("big", i, *e) for i, e in enumerate(edits)], PATCH).repartition(8)
    source = spark.createDataFrame([("big", "\n".join(f"l{i}" for i in range(1, n + 1))), ("other", "x")], FILE)
    done = P.apply_patches(P.accepted_patches(table, source), source)
    lines = done.orderBy("line_no").collect()
    assert [r.line for r in lines] == plain([f"l{i}" for i in range(1, n + 1)], edits)
    assert [r.line_no for r in lines] == list(range(1, len(lines) + 1))
    # the lines of the one file lie in ranges of the order, not in one task
    assert P.patch_conflicts(table.union(table.where("seq = 5"))).count() == 1


def test_equal_appends_and_nothing_left(spark):
    source = spark.createDataFrame([("f", "1\n2"), ("g", "1")], FILE)
    twice = spark.createDataFrame([("f", 0, "append", 0, 0, "a\nb")] * 2 + [("g", 0, "delete", 1, 1, None)], PATCH)
    got = [(r.path, r.line_no, r.line) for r in P.apply_patches(twice, source).orderBy("path", "line_no").collect()]
    assert got == [("f", i + 1, line) for i, line in enumerate(["1", "2", "a", "b", "a", "b"])]


def test_no_plan_gathers_a_file(spark, file):
    table = patches(spark, ("patch", 1, 1, "x"), ("append", 0, 0, "y"))
    for made in (P.patch_conflicts(table), P.apply_patches(table, file)):
        plan = made._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "windowspecdefinition(path" not in plan


def test_one_bad_patch_refuses_the_file(spark, file):
    bad = patches(spark, ("patch", 1, 1, "x"), ("delete", 9, 9, None))
    assert P.accepted_patches(bad, file).isEmpty()
    clash = patches(spark, ("patch", 1, 2, "x"), ("delete", 2, 2, None))
    assert P.accepted_patches(clash, file).isEmpty()


def test_lines_affected(spark):
    got = P.lines_affected(patches(spark, ("patch", 1, 3, "x"), ("insert", 4, 4, "a\nb"), ("delete", 6, 6, None), ("append", 0, 0, "z")))
    assert rows(got) == [("f", 4, 7)]


def test_write_modes(spark):
    files = spark.createDataFrame([("a",)], "path string")
    asked = [(p, m) for p in "ab" for m in ("create", "overwrite", "upsert")]
    got = P.write_mode_check(spark.createDataFrame(asked, "path string, mode string"), files)
    assert {(r.path, r["mode"]): r.error for r in got.collect()} == {
        ("a", "create"): "already exists", ("a", "overwrite"): "", ("a", "upsert"): "", ("b", "create"): "",
        ("b", "overwrite"): "does not exist", ("b", "upsert"): "",
    }


def test_moves_run_together_or_not_at_all(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    moves = spark.createDataFrame(
        [(1, "a", "x"), (1, "b", "c"), (2, "c", "y"), (3, "nope", "z"), (4, "b", "../z"), (5, "a", "bin/a")], "batch int, source string, target string"
    )
    got = {(r.batch, r.source): (r.error, r.executed) for r in P.plan_moves(moves, files).collect()}
    assert got == {
        (1, "a"): ("", False), (1, "b"): ("target exists", False), (2, "c"): ("", True), (3, "nope"): ("source not found", False),
        (4, "b"): ("path_traversal", False), (5, "a"): ("blocked_dir", False),
    }


def test_deletes_stand_alone(spark):
    files = spark.createDataFrame([("a",)], "path string")
    asked = spark.createDataFrame([("a", False), ("b", False), ("gone", True), ("logs", True)], "path string, is_folder boolean")
    got = {r.path: (r.error, r.success) for r in P.plan_deletes(asked, files).collect()}
    assert got == {"a": ("", True), "b": ("file not found", False), "gone": ("", True), "logs": ("blocked_dir", False)}


def test_outcomes(spark):
    df = spark.createDataFrame([(1, True, 3), (1, False, 9), (2, True, 1)], "b int, success boolean, lines_affected int")
    assert rows(P.batch_outcome(df, "b")) == [(1, 1, 1, 3), (2, 1, 0, 1)]


def test_folder_members(spark):
    files = spark.createDataFrame([("Src/a.cs",), ("src\\sub\\b.cs",), ("srcx/c.cs",)], "path string")
    folders = spark.createDataFrame([("SRC/",), ("src/sub",)], "folder string")
    assert rows(P.folder_members(files, folders)) == [("SRC/", "Src/a.cs"), ("SRC/", "src\\sub\\b.cs"), ("src/sub", "src\\sub\\b.cs")]
