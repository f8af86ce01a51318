"""Reading source trees.

Spark's file sources leave out files of no bytes, so the trees are listed by
tasks, in rounds over the folders found, and the contents of the rest are read by
Spark. Listing runs when a reader is called; the rows are read from its copy. Paths are those below the root, in plain characters. Listing needs a file
system that pyarrow knows (local, HDFS, S3, …).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.policy import extension, file_name
from lodeline.session import stored

# Entries that a task lists below one folder before it gives the rest back.
LISTED_ENTRIES = 10_000
_LISTING = "path string, size_bytes bigint, modified_at timestamp"


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as the file system names it, without a slash at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _plain(uri: str) -> str:
    """A URI with one slash behind its scheme."""
    return re.sub(r"^([^:/]+):/+", r"\1:/", uri)


def _below(path: Column, root: str) -> Column:
    """What follows the root in a path that begins with it."""
    one_slash = F.regexp_replace(path, r"^([^:/]+):/+", "$1:/")
    return F.substr(one_slash, F.lit(len(_plain(root)) + 2))


def _decoded(uri: Column) -> Column:
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def glob_pattern(glob: str) -> str:
    """The regular expression of a file name pattern with ``*``, ``?``, ``[…]`` and ``{a,b}``."""
    out, depth = [], 0
    for part in re.findall(r"\[[^\]]*\]|.", glob, re.S):
        if part in "*?":
            out.append("[^/]*" if part == "*" else "[^/]")
        elif part.startswith("["):
            out.append(part.replace("[!", "[^", 1))
        elif part == "{" or (part == "}" and depth):
            depth += 1 if part == "{" else -1
            out.append("(?:" if part == "{" else ")")
        else:
            out.append("|" if part == "," and depth else re.escape(part))
    return f"^{''.join(out)}$"


def _entries(spark: SparkSession, uri: str, folders: DataFrame, limit: int) -> DataFrame:
    """What stands in the ``folders``, paths below the root.

    A task goes down into what it finds until it has listed ``limit`` entries
    for a folder; the folders it has not opened by then come out as ``is_open``.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, start = fs.FileSystem.from_uri(uri)
        start = start.rstrip("/")

        def opened(folder: str) -> Iterator[pa.RecordBatch]:
            todo, seen = [folder], 0
            while todo and seen < limit:
                here = todo.pop()
                found = system.get_file_info(fs.FileSelector(f"{start}/{here}" if here else start or "/"))
                seen += len(found)
                below = [(info, info.path[len(start) + 1 :]) for info in found]
                # As in Spark, names that begin with a dot or an underscore are hidden.
                below = [(info, path) for info, path in below if path.rsplit("/", 1)[-1][:1] not in "._"]
                todo += [path for info, path in below if info.type == fs.FileType.Directory]
                files = [(path, info.size, info.mtime) for info, path in below if info.type == fs.FileType.File]
                yield batch(files, False)
            yield batch([(path, None, None) for path in todo], True)

        def batch(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            paths, sizes, times = zip(*rows) if rows else ((), (), ())
            columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", tz="UTC"))]
            columns.append(pa.array([is_open] * len(rows), pa.bool_()))
            return pa.RecordBatch.from_arrays(columns, names=["path", "size_bytes", "modified_at", "is_open"])

        for part in batches:
            for folder in part.column(0).to_pylist():
                yield from opened(folder)

    return folders.mapInArrow(walk, f"{_LISTING}, is_open boolean")


def _listed(spark: SparkSession, root: str, limit: int = LISTED_ENTRIES) -> DataFrame:
    """Path below the root, size and time of every file, those of no bytes too.

    The tree is listed in rounds. What a round leaves unopened is dealt out anew
    to all tasks, so a tree that hangs on one folder is spread as soon as it
    branches. Rounds are written to the shared folder; a lost task lists its
    folders again.
    """
    uri = re.sub(r"^file:/+", "file:///", _qualified(spark, root))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    folders, waiting, rounds = spark.createDataFrame([("",)], "path string"), 1, []
    while waiting:
        listed = stored(_entries(spark, uri, folders.repartition(min(waiting, tasks)), limit))
        rounds.append(listed.where("not is_open").drop("is_open"))
        folders = listed.where("is_open").select("path")
        waiting = folders.count()
    return reduce(DataFrame.union, rounds)


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below ``root`` with size and time. No content is read."""
    name = file_name(F.col("path"))
    return _listed(spark, root).where(F.rlike(name, F.lit(glob_pattern(glob)))).select(
        "path", name.alias("name"), extension(F.col("path")).alias("ext"), "size_bytes", "modified_at"
    )


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Whole text of the files below ``root``, one row per file, with size and time."""
    base = _qualified(spark, root)
    texts = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select(
            _below(_decoded(F.col("_metadata.file_path")), base).alias("path"),
            F.col("value").alias("content"),
            F.col("_metadata.file_size").alias("size_bytes"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
    )
    empty = scan_files(spark, root, glob).where("size_bytes = 0").select("path", F.lit("").alias("content"), "size_bytes", "modified_at")
    path = F.col("path")
    return texts.unionByName(empty).select(
        "path", file_name(path).alias("name"), extension(path).alias("ext"), "content", "size_bytes", "modified_at"
    )
