"""The stored index: folders of rows per project and bucket, in generations.

Rows lie under ``rows/project=…/bucket=…/generation=…`` and are never changed in
place; the bucket is a hash of the path, so that a change in a project that
holds a large share of all rows rewrites a small part of it. A small log names
the generation of each (project, bucket) that counts, and readers open only the
folders it names: what is dead is neither listed nor read, and ``remove_dead``
takes it away. A write first stores its rows and then appends its log entries,
so readers see the old rows or the new ones, and a job that fails or is repeated
leaves nothing that is read. The number of buckets is stored with the index.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions.policy import path_key

LOG_SCHEMA = "project string, bucket int, generation string, stamp bigint, live boolean"
BUCKETS = 16
UNIT = ["project", "bucket"]
Unit = tuple[str | None, int]


def new_generation() -> tuple[str, int]:
    stamp = time.time_ns()
    return f"{stamp:020d}-{uuid.uuid4().hex[:8]}", stamp


def bucket_of(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path_key(path)), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def bucket_count(spark: SparkSession, root: str, asked: int | None = None) -> int:
    """The number of buckets of an index: what it was made with, or what is asked for at its first write."""
    system, path = _folder(spark, f"{root}/buckets")
    if system.exists(path):
        return spark.read.schema("buckets int").parquet(f"{root}/buckets").first()["buckets"]
    buckets = asked or BUCKETS
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{root}/buckets")
    return buckets


def _append_log(spark: SparkSession, root: str, generation: str, stamp: int, live: list[Unit], dead: list[Unit]) -> None:
    """One entry per project and bucket."""
    entries = [(*unit, generation, stamp, True) for unit in live] + [(*unit, generation, stamp, False) for unit in dead]
    if entries:
        spark.createDataFrame(entries, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/log")


def current_generations(spark: SparkSession, root: str) -> DataFrame:
    """The generation of each (project, bucket) that counts."""
    log = spark.read.schema(LOG_SCHEMA).parquet(f"{root}/log")
    latest = log.groupBy(*UNIT).agg(
        F.max_by(F.struct("generation", "live"), F.struct("stamp", "generation")).alias("g")
    )
    return latest.where("g.live").select(*UNIT, "g.generation")


def _store(rows: DataFrame, root: str, generation: str, buckets: int) -> list[Unit]:
    """Write rows by unit, from one reading of them, and return the units that have any.

    Large units are split over tasks, small ones share one.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("bucket", bucket_of(F.col("path"), buckets)).withColumn("generation", F.lit(generation))
    (
        placed.hint("rebalance", F.col("project"), F.col("bucket"))
        .write.mode("append")
        .partitionBy("project", "bucket", "generation")
        .parquet(f"{root}/rows")
    )
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    system, path = _folder(spark, f"{root}/rows/project=*/bucket=*/generation={generation}")
    units = []
    for status in system.globStatus(path) or []:
        bucket = status.getPath().getParent()
        name = bucket.getParent().getName().split("=", 1)[1]
        project = None if name == named.DEFAULT_PARTITION_NAME() else named.unescapePathName(name)
        units.append((project, int(bucket.getName().split("=", 1)[1])))
    return units


def write_index(
    rows: DataFrame, root: str, projects: DataFrame | None = None, buckets: int | None = None
) -> None:
    """Replace all rows of the given projects, or of those in ``rows``, in one step.

    A project named in ``projects`` that has no row in ``rows`` is emptied.
    ``buckets`` counts for the first write of an index.
    """
    spark = rows.sparkSession
    buckets = bucket_count(spark, root, buckets)
    generation, stamp = new_generation()
    live = _store(rows, root, generation, buckets)
    names = {p for p, _ in live} if projects is None else {r["project"] for r in projects.select("project").distinct().collect()}
    whole = {(name, bucket) for name in names for bucket in range(buckets)}
    _append_log(spark, root, generation, stamp, live, sorted(whole - set(live), key=str))


def _touched(changed: DataFrame, buckets: int) -> list[Unit]:
    """Units that hold the changed paths."""
    units = changed.select("project", bucket_of(F.col("path"), buckets).alias("bucket")).distinct()
    return [(unit["project"], unit["bucket"]) for unit in units.collect()]


def rewrite_touched(rows: DataFrame, root: str, changed: DataFrame) -> None:
    """Replace the buckets that hold the changed paths; ``rows`` is what they hold from now on."""
    spark = rows.sparkSession
    buckets = bucket_count(spark, root)
    generation, stamp = new_generation()
    live = _store(rows, root, generation, buckets)
    emptied = sorted(set(_touched(changed, buckets)) - set(live), key=str)
    _append_log(spark, root, generation, stamp, live, emptied)


def purge_projects(projects: DataFrame, root: str) -> None:
    """Drop every row of the given projects."""
    spark = projects.sparkSession
    generation, stamp = new_generation()
    names = {r["project"] for r in projects.select("project").distinct().collect()}
    every = [(name, bucket) for name in sorted(names) for bucket in range(bucket_count(spark, root))]
    _append_log(spark, root, generation, stamp, [], every)


def _unit_path(spark: SparkSession, root: str, project: str | None, bucket: int, generation: str) -> str:
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    name = named.DEFAULT_PARTITION_NAME() if project is None else named.escapePathName(project)
    return f"{root}/rows/project={name}/bucket={bucket}/generation={generation}"


def _rows(spark: SparkSession, root: str, schema: T.StructType, live: DataFrame) -> DataFrame:
    """The rows of live generations, from their folders alone."""
    keys = ("project", "bucket", "generation")
    full = T.StructType(
        [f for f in schema.fields if f.name not in keys]
        + [T.StructField("project", T.StringType()), T.StructField("bucket", T.IntegerType())]
        + [T.StructField("generation", T.StringType())]
    )
    paths = [_unit_path(spark, root, *unit) for unit in live.select(*UNIT, "generation").collect()]  # one per unit
    if not paths:
        return spark.createDataFrame([], full).drop("bucket", "generation")
    read = spark.read.schema(full).option("basePath", f"{root}/rows").parquet(*paths)
    return read.drop("bucket", "generation")


def read_index(spark: SparkSession, root: str, schema: T.StructType, project: str = "*") -> DataFrame:
    """Current rows of one project or of all. Only live generations are listed and scanned."""
    live = current_generations(spark, root)
    return _rows(spark, root, schema, live if project == "*" else live.where(F.col("project") == project))


def read_touched(spark: SparkSession, root: str, schema: T.StructType, changed: DataFrame) -> DataFrame:
    """Current rows of the buckets that hold the changed paths."""
    units = _touched(changed, bucket_count(spark, root))
    wanted = spark.createDataFrame(units, "project string, bucket int")
    live = current_generations(spark, root)
    same = live["project"].eqNullSafe(wanted["project"]) & (live["bucket"] == wanted["bucket"])
    return _rows(spark, root, schema, live.join(wanted, same, "left_semi"))


def remove_dead(spark: SparkSession, root: str, older_than: str | None = None) -> int:
    """Delete the folders that no reader opens any more, and return their number.

    ``older_than`` spares generations from that name on, which a running write
    or reader may still need; names begin with the time they were made.
    """
    live = {tuple(row) for row in current_generations(spark, root).select(*UNIT, "generation").collect()}
    kept = {_unit_path(spark, root, *unit).split("/rows/", 1)[1] for unit in live}
    system, path = _folder(spark, f"{root}/rows/project=*/bucket=*/generation=*")
    removed = 0
    for status in system.globStatus(path) or []:
        folder = status.getPath()
        name = "/".join([folder.getParent().getParent().getName(), folder.getParent().getName(), folder.getName()])
        generation = folder.getName().split("=", 1)[1]
        if name not in kept and (older_than is None or generation < older_than):
            removed += bool(system.delete(folder, True))
    return removed


def evict_paths(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of files other than the given ones, compared by normalised path."""
    gone = paths.select("project", path_key(F.col("path")).alias("_key")).distinct()
    return (
        index.withColumn("_key", path_key(F.col("path")))
        .join(gone, ["project", "_key"], "left_anti")
        .drop("_key")
    )


def evict_prefix(index: DataFrame, folder: str) -> DataFrame:
    """Rows of files that are not below a folder, ignoring case and kind of slash."""
    prefix = folder.replace("\\", "/").rstrip("/").lower() + "/"
    return index.where(~F.startswith(path_key(F.col("path")), F.lit(prefix)))


def evict_stored(spark: SparkSession, root: str, schema: T.StructType, paths: DataFrame) -> None:
    """Drop the given files from the stored index; other buckets are not read or written."""
    held = read_touched(spark, root, schema, paths)
    rewrite_touched(evict_paths(held, paths), root, paths)


def read_through(
    index: DataFrame, cached: DataFrame, base: DataFrame, compute: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Rows for every indexed path, and those that had to be computed.

    What the cache lacks is taken from ``base`` through ``compute``; the second
    frame is what is to be appended to the cache.
    """
    keys = ["project", "path"]
    missing = index.select(*keys).distinct().join(cached.select(*keys), keys, "left_anti")
    filled = compute(base.join(missing, keys, "left_semi"))
    have = cached.join(index.select(*keys).distinct(), keys, "left_semi")
    return have.unionByName(filled), filled


def with_cached(index: DataFrame, cached: DataFrame, *keys: str) -> DataFrame:
    """Every indexed row with its cached row, or nulls to be filled later."""
    return index.join(cached.withColumn("is_cached", F.lit(True)), list(keys), "left").withColumn(
        "is_cached", F.coalesce("is_cached", F.lit(False))
    )


def changed_content(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content differs from what is stored, by hash of the content.

    ``stored`` has (project, path, content_hash).
    """
    hashed = files.withColumn("content_hash", F.xxhash64("content"))
    return hashed.join(stored, ["project", "path", "content_hash"], "left_anti")
