import pytest
from helpers import rows
from pyspark.sql import functions as F

from lodeline.functions.text import split_line_count
from lodeline.sources import index as X
from lodeline.sources.files import _listed, read_files, scan_files
from lodeline.streaming.jobs import full_pass

ROW = "project string, path string, n int"
DATA = [("a", "x.cs", 1), ("a", "y.cs", 2), ("b", "X.cs", 3)]


@pytest.fixture
def root(spark, tmp_path):
    X.write_index(spark.createDataFrame(DATA, ROW), str(tmp_path / "index"), buckets=4)
    return str(tmp_path / "index")


def now(spark, root, project="*"):
    schema = spark.createDataFrame([], ROW).schema
    return rows(X.read_index(spark, root, schema, project).select("project", "path", "n"))


def test_write_and_read(spark, root):
    assert now(spark, root) == DATA
    assert now(spark, root, "b") == DATA[2:]


def test_replace_one_project(spark, root):
    X.write_index(spark.createDataFrame([("a", "z.cs", 9)], ROW), root, buckets=4)
    assert now(spark, root) == [("a", "z.cs", 9), ("b", "X.cs", 3)]


def test_empty_and_purge(spark, root):
    none = spark.createDataFrame([], ROW)
    X.write_index(none, root, spark.createDataFrame([("a",)], "project string"), buckets=4)
    assert now(spark, root) == DATA[2:]
    X.purge_projects(spark.createDataFrame([("b",)], "project string"), root)
    assert now(spark, root) == []
    X.write_index(spark.createDataFrame(DATA, ROW), root, buckets=4)
    assert now(spark, root) == DATA


def test_evict_then_add_again(spark, root):
    schema = spark.createDataFrame([], ROW).schema
    gone = spark.createDataFrame([("a", "X.CS")], "project string, path string")
    X.evict_stored(spark, root, schema, gone)
    assert now(spark, root) == DATA[1:]
    held = X.read_touched(spark, root, schema, gone)
    X.rewrite_touched(held.unionByName(spark.createDataFrame(DATA[:1], ROW)), root, gone)
    assert now(spark, root) == DATA


def test_a_failed_write_is_not_seen(spark, root):
    # rows without a log entry, as left by a job that died before its last step
    X._store(spark.createDataFrame([("a", "x.cs", 77)], ROW), root, "00000-dead", 4)
    assert now(spark, root) == DATA


def test_evict_prefix(spark):
    df = spark.createDataFrame([("Src/a",), ("src\\b",), ("srcx/a",), ("src",)], "path string")
    assert rows(X.evict_prefix(df, "SRC")) == [("src",), ("srcx/a",)]


def test_read_through(spark):
    index = spark.createDataFrame(DATA, ROW).select("project", "path")
    cached = spark.createDataFrame([("a", "x.cs", 100), ("z", "old.cs", 5)], ROW)
    every, filled = X.read_through(index, cached, spark.createDataFrame(DATA, ROW), lambda df: df.withColumn("n", -F.col("n")))
    assert rows(every) == [("a", "x.cs", 100), ("a", "y.cs", -2), ("b", "X.cs", -3)]
    assert rows(filled) == [("a", "y.cs", -2), ("b", "X.cs", -3)]
    joined = X.with_cached(index, cached, "project", "path")
    assert rows(joined.select("path", "is_cached")) == [("X.cs", False), ("x.cs", True), ("y.cs", False)]


def test_only_changed_content(spark):
    files = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "project string, path string, content string")
    stored = files.where("path <> 'c'").select("project", "path", F.xxhash64(F.when(F.col("path") == "b", "old").otherwise(F.col("content"))).alias("content_hash"))
    assert rows(X.changed_content(files, stored).select("path")) == [("b",), ("c",)]


def test_files_on_disk(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    (tree / "a.cs").write_text("one\ntwo\n")
    (tree / "sub" / "B.CS.txt").write_text("é")
    (tree / "sub" / "c.cs").write_text("")
    (tree / "sub" / "d.cs").write_text("x")
    assert rows(scan_files(spark, str(tree), "*.cs").select("path", "name", "ext", "size_bytes")) == [
        ("a.cs", "a.cs", ".cs", 8), ("sub/c.cs", "c.cs", ".cs", 0), ("sub/d.cs", "d.cs", ".cs", 1),
    ]
    got = read_files(spark, str(tree)).select("path", "ext", "content", "size_bytes", split_line_count(F.col("content")))
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert found["a.cs"] == (".cs", "one\ntwo\n", 8, 3) and found["sub/B.CS.txt"] == (".txt", "é", 2, 1)
    assert scan_files(spark, str(tree)).select("modified_at").where("modified_at is null").isEmpty()


def test_full_pass_takes_enabled_projects(spark, tmp_path):
    files = spark.createDataFrame(DATA, ROW)
    registry = spark.createDataFrame([("a", True), ("b", False)], "name string, enabled boolean")
    full_pass(files, registry, str(tmp_path / "i"), lambda df: df)
    assert now(spark, str(tmp_path / "i")) == DATA[:2]


def test_trees_with_odd_names(spark, tmp_path):
    root = tmp_path / "app"
    wanted = {
        "a.cs": "top", "lib/app/a.cs": "below", "b c.cs": "blank", "x+y%20z.cs": "signs", "lib/empty.cs": "", "é/ü.cs": "ö", "lib/n.txt": "no", ".git/h.cs": "",
    }
    for path, content in wanted.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content, encoding="utf-8")
    seen = {p: c for p, c in wanted.items() if p.endswith(".cs") and not p.startswith(".")}
    scanned = {r.path: r.size_bytes for r in scan_files(spark, str(root), "*.cs").collect()}
    read = {r.path: (r.content, r.size_bytes) for r in read_files(spark, str(root), "*.cs").collect()}
    assert scanned == {p: len(c.encode()) for p, c in seen.items()}
    assert read == {p: (c, len(c.encode())) for p, c in seen.items()}
    both = scan_files(spark, str(root), "*.{cs,txt}").select("path", "modified_at").exceptAll(read_files(spark, str(root)).select("path", "modified_at"))
    assert scan_files(spark, str(root), "*.{cs,txt}").count() == len(seen) + 1 and both.count() <= len(seen) + 1


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_a_tree_under_one_folder_is_dealt_out(spark, tmp_path, limit):
    root, want = tmp_path / "tree", {}
    for i in range(60):
        path = f"only/d{i % 6}/e{i % 12}/f{i}.cs"
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x" * i)
        want[path] = i
    (root / "only" / "_hidden").mkdir()
    (root / "only" / "_hidden" / "no.cs").write_text("x")
    (root / "only" / "bare").mkdir()
    got = [(r.path, r.size_bytes) for r in _listed(spark, str(root), limit).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_only_live_folders_are_opened(spark, tmp_path):
    root, schema = str(tmp_path / "i"), "project string, path string, n bigint"
    rows_ = spark.range(400).selectExpr("concat('p:%/', id % 3) AS project", "concat(id, '.cs') AS path", "id AS n")
    for factor in (1, 2, 3):
        X.write_index(rows_.withColumn("n", F.col("n") * factor), root, buckets=8)
    kind = spark.createDataFrame([], schema).schema
    whole = X.read_index(spark, root, kind)
    generations = {part for f in whole.inputFiles() for part in f.split("/") if part.startswith("generation=")}
    assert len(generations) == 1 and whole.agg(F.sum("n")).first()[0] == 3 * sum(range(400))
    one = X.read_touched(spark, root, kind, spark.createDataFrame([("p:%/1", "1.cs")], "project string, path string"))
    assert len({f.rsplit("/", 1)[0] for f in one.inputFiles()}) == 1 and one.where("path = '1.cs'").first()["n"] == 3
    assert X.remove_dead(spark, root) == 2 * 3 * 8 and X.remove_dead(spark, root) == 0
    assert X.read_index(spark, root, kind).count() == 400
    assert X.bucket_count(spark, root, 99) == 8
