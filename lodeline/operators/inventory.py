"""File trees, profiles and file information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import policy as P
from lodeline.functions.text import LARGE_BYTES, format_size, read_line_count

COLLAPSE_ABOVE = 50


def file_info(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Existence, lines, bytes, extension and time of change of each requested path.

    The time is null where the files come without ``modified_at``.
    """
    modified = F.col("modified_at") if "modified_at" in files.columns else F.lit(None).cast("timestamp")
    facts = files.select(
        F.col("path"),
        read_line_count(F.col("content")).cast("bigint").alias("line_count"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        P.extension(F.col("path")).alias("ext"),
        modified.alias("modified_at"),
        F.lit(True).alias("found"),
    )
    return requests.select("path").distinct().join(facts, "path", "left").select(
        "path",
        F.coalesce("found", F.lit(False)).alias("exists"),
        F.coalesce("line_count", F.lit(-1)).alias("line_count"),
        F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"),
        F.coalesce("ext", F.lit("")).alias("ext"),
        "modified_at",
    )


def enrich_results(results: DataFrame, info: DataFrame) -> DataFrame:
    """Add file facts to successful rows, matching paths without regard to case."""
    facts = info.where("exists").select(
        F.lower("path").alias("_key"), "line_count", "size_bytes"
    )
    return (
        results.withColumn("_key", F.when(F.col("success"), F.lower("path")))
        .join(facts, "_key", "left")
        .drop("_key")
    )


def collapse_large_folders(files: DataFrame, above: int = COLLAPSE_ABOVE) -> DataFrame:
    """Files of small folders one by one; a large folder becomes one row with its count."""
    keys = ["project", "folder"]
    placed = files.select("project", P.folder_of(F.col("path")).alias("folder"), "path")
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("files"))
    small = sizes.where(F.col("files") <= above)
    large = sizes.where(F.col("files") > above)
    listed = placed.join(small, keys).select(*keys, "path", "files", F.lit(False).alias("collapsed"))
    folded = large.select(*keys, F.lit("").alias("path"), "files", F.lit(True).alias("collapsed"))
    return listed.unionByName(folded)


def ancestors(path: Column) -> Column:
    """All folders above a path, the root first as an empty string."""
    parts = F.filter(P.segments(P.folder_of(path)), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def folder_tree(files: DataFrame) -> DataFrame:
    """Files, bytes, lines and large files at or below each folder."""
    return (
        files.select(
            "project",
            F.explode(ancestors(F.col("path"))).alias("folder"),
            F.col("size_bytes").cast("bigint").alias("size_bytes"),
            F.col("line_count").cast("bigint").alias("line_count"),
            (F.col("size_bytes") > LARGE_BYTES).alias("large"),
        )
        .groupBy("project", "folder")
        .agg(
            F.count("*").alias("files"),
            F.sum("size_bytes").alias("size_bytes"),
            F.sum("line_count").alias("line_count"),
            F.count_if("large").alias("large_files"),
        )
        .withColumn("depth", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))))
        .withColumn("size", format_size(F.col("size_bytes")))
    )


def last_siblings(files: DataFrame) -> DataFrame:
    """Mark the last entry of each folder, which closes its branch in a tree drawing."""
    placed = files.select("project", P.folder_of(F.col("path")).alias("folder"), "path")
    last = placed.groupBy("project", "folder").agg(F.max("path").alias("_last"))
    return placed.join(last, ["project", "folder"]).select(
        "project", "folder", "path", (F.col("path") == F.col("_last")).alias("is_last")
    )


def folder_listing(files: DataFrame, folder: str, pattern: str | None = None) -> DataFrame:
    """Files directly in a folder whose name contains the pattern, ignoring case."""
    name = P.file_name(F.col("path"))
    found = files.where(P.folder_of(F.col("path")) == folder.strip("/"))
    if pattern and pattern.strip():
        found = found.where(F.contains(F.lower(name), F.lit(pattern.strip().lower())))
    return found.withColumn("name", name)


def file_index(types: DataFrame, methods: DataFrame) -> DataFrame:
    """Types and methods per file."""
    n_types = types.groupBy("project", "path").agg(F.count("*").alias("types"))
    n_methods = methods.groupBy("project", "path").agg(F.count("*").alias("methods"))
    return n_types.join(n_methods, ["project", "path"], "full").select(
        "project",
        "path",
        F.coalesce("types", F.lit(0)).alias("types"),
        F.coalesce("methods", F.lit(0)).alias("methods"),
    )


def target_framework(xml: Column) -> Column:
    return F.nullif(
        F.regexp_extract(xml, r"(?i)<TargetFramework>(.*?)</TargetFramework>", 1), F.lit("")
    )


def solution_files(files: DataFrame) -> DataFrame:
    """Solution files at the top of each project, ``.sln`` before ``.slnx``."""
    ext = P.extension(F.col("path"))
    return files.where(ext.isin(".sln", ".slnx") & (P.folder_of(F.col("path")) == "")).select(
        "project", "path", F.when(ext == ".sln", 0).otherwise(1).alias("rank")
    )


def project_profile(files: DataFrame, manifest_ext: str = ".csproj") -> DataFrame:
    """Solution flag, number of manifests and framework of the first one, per project."""
    ext = P.extension(F.col("path"))
    top = P.folder_of(F.col("path")) == ""
    manifest = (ext == manifest_ext) & P.not_excluded_dir(F.col("path"), P.WATCH_DIRS)
    return (
        files.groupBy("project")
        .agg(
            F.bool_or(top & ext.isin(".sln", ".slnx")).alias("has_solution"),
            F.count_if(manifest).alias("manifests"),
            F.min_by(
                F.when(manifest, F.coalesce(target_framework(F.col("content")), F.lit(""))),
                F.when(manifest, F.col("path")),
            ).alias("framework"),
        )
        .withColumn("is_valid", F.col("has_solution") | (F.col("manifests") > 0))
    )


def deepest_first(folders: DataFrame, path: str = "path") -> DataFrame:
    """Folders ordered so that children come before their parents."""
    depth = F.size(F.filter(P.segments(F.col(path)), lambda p: p != ""))
    return folders.withColumn("depth", depth).orderBy(F.desc("depth"), path)
