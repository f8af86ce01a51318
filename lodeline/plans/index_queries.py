"""Queries that store, read, evict and refill the index."""

from pyspark.sql import functions as F

from lodeline.functions.text import split_line_count
from lodeline.plans import views as V
from lodeline.plans.registered import fresh_dir, query
from lodeline.sources import index as X
from lodeline.sources.files import read_files as read_tree
from lodeline.sources.files import scan_files as scan_tree
from lodeline.streaming.jobs import full_pass as index_all


BUCKETS = 4


def analyse(files):
    return files.select("project", "path", "size_bytes", split_line_count(F.col("content")).alias("lines"))


ANALYSED = """index_v AS (SELECT project, path, size_bytes, len(string_split(content, chr(10))) AS lines FROM files_v)"""
BASE = f"WITH {V.FILES}, {ANALYSED}"


def stored(spark, d, label):
    rows = analyse(V.files(spark, d))
    root = fresh_dir(spark, label)
    X.write_index(rows, root, buckets=BUCKETS)
    return rows, root


@query("read_index", f"{BASE} SELECT * FROM index_v WHERE project = 'src1'")
def read_index(spark, d):
    rows, root = stored(spark, d, "read-index")
    return X.read_index(spark, root, rows.schema, "src1").select("project", "path", "size_bytes", "lines")


@query(
    "write_index",
    f"{BASE} SELECT project, path, size_bytes + CASE WHEN project < 'src2' THEN 1 ELSE 0 END AS size_bytes, lines FROM index_v",
)
def write_index(spark, d):
    """A second write replaces the projects it holds and leaves the others."""
    rows, root = stored(spark, d, "write-index")
    again = rows.where("project < 'src2'").withColumn("size_bytes", F.col("size_bytes") + 1)
    X.write_index(again, root, buckets=BUCKETS)
    return X.read_index(spark, root, rows.schema).select("project", "path", "size_bytes", "lines")


@query("purge_project", f"{BASE} SELECT * FROM index_v WHERE project <> 'src0'")
def purge_project(spark, d):
    rows, root = stored(spark, d, "purge")
    X.purge_projects(rows.where("project = 'src0'"), root)
    return X.read_index(spark, root, rows.schema).select("project", "path", "size_bytes", "lines")


@query(
    "evict_paths",
    """SELECT source AS project, lang || '/' || doc_id || '.txt' AS path, strlen(text) AS size_bytes,
      len(string_split(text, chr(10))) AS lines FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def evict_paths(spark, d):
    """Drop the labelled documents, named in capitals and with back slashes, and store what is left."""
    rows, root = stored(spark, d, "evict")
    labelled = V.files(spark, d).join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    gone = labelled.select("project", F.upper(F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"))
    X.evict_stored(spark, root, rows.schema, gone)
    return X.read_index(spark, root, rows.schema).select("project", "path", "size_bytes", "lines")


@query(
    "evict_prefix",
    f"WITH {V.PAGES} SELECT page_id, project, path FROM pages_v WHERE NOT starts_with(lower(path), 'en/')",
)
def evict_prefix(spark, d):
    return X.evict_prefix(V.pages(spark, d), "EN").select("page_id", "project", "path")


CACHED = "cached_v AS (SELECT i.project, i.path, i.size_bytes, -1 AS lines FROM files_v f JOIN index_v i USING (project, path) JOIN labels USING (doc_id))"


def cached_rows(spark, d):
    labelled = V.files(spark, d).join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return analyse(labelled).withColumn("lines", F.lit(-1))


@query(
    "read_through",
    f"""{BASE}, {CACHED} SELECT * FROM cached_v UNION ALL SELECT * FROM index_v WHERE (project, path) NOT IN (SELECT (project, path) FROM cached_v)""",
)
def read_through(spark, d):
    files = V.files(spark, d)
    everything, _ = X.read_through(files, cached_rows(spark, d), files, analyse)
    return everything


@query(
    "index_with_cache",
    f"""{BASE}, {CACHED} SELECT i.project, i.path, coalesce(c.lines, 0) AS cached_lines, c.path IS NOT NULL AS is_cached
    FROM index_v i LEFT JOIN cached_v c ON c.project = i.project AND c.path = i.path""",
)
def index_with_cache(spark, d):
    have = cached_rows(spark, d).select("project", "path", F.col("lines").alias("cached_lines"))
    joined = X.with_cached(V.files(spark, d).select("project", "path"), have, "project", "path")
    return joined.withColumn("cached_lines", F.coalesce("cached_lines", F.lit(0)))


@query(
    "changed_content",
    f"WITH {V.FILES} SELECT project, path FROM files_v WHERE doc_id % 5 = 0",
)
def changed_content(spark, d):
    """A fifth of the documents got a new last word since they were stored."""
    old = V.files(spark, d)
    new = old.withColumn(
        "content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(" end"))).otherwise(F.col("content"))
    )
    kept = old.select("project", "path", F.xxhash64("content").alias("content_hash"))
    return X.changed_content(new, kept).select("project", "path")


@query(
    "full_pass",
    f"{BASE} SELECT * FROM index_v WHERE length(project) = 4",
)
def full_pass(spark, d):
    files = V.files(spark, d)
    registry = files.select(F.col("project").alias("name")).distinct().withColumn("enabled", F.length("name") == 4)
    root = fresh_dir(spark, "full-pass")
    index_all(files, registry, root, analyse)
    return X.read_index(spark, root, analyse(files).schema).select("project", "path", "size_bytes", "lines")


def written_tree(spark, d, label):
    """Documents written as one text file per folder."""
    root = f"{fresh_dir(spark, label)}/tree"
    docs = V.files(spark, d).select("project", "lang", "content")
    docs.repartition("project", "lang").write.partitionBy("project", "lang").text(root)
    return root


@query(
    "scan_files",
    """SELECT source AS project, lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY ALL""",
)
def scan_files(spark, d):
    found = scan_tree(spark, written_tree(spark, d, "scan-files"), "*.txt")
    return (
        found.groupBy(
            F.regexp_extract("path", "project=([^/]+)", 1).alias("project"), F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")
        ).agg(F.sum("size_bytes").alias("size_bytes"))
    )


@query(
    "read_tree",
    """SELECT source AS project, lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines
    FROM documents GROUP BY ALL""",
)
def read_tree_lines(spark, d):
    found = read_tree(spark, written_tree(spark, d, "read-tree"), "*.txt")
    return (
        found.groupBy(
            F.regexp_extract("path", "project=([^/]+)", 1).alias("project"), F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")
        ).agg(
            F.sum(F.length("content")).alias("n_chars"),
            F.sum(split_line_count(F.col("content")) - 1).alias("n_lines"),
        )
    )
