"""Line patches and batches of file operations, as plans over tables.

Patches have (path, seq, action, start_line, end_line, content) with actions
``patch``, ``insert``, ``delete`` and ``append``. Line numbers are those of the
file before any patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.policy import path_key, write_reason
from lodeline.functions.text import read_line_count
from lodeline.operators.ordered import with_next, with_row_number

LAST_LINE = 2147483647
# Lines of a replaced range that one row is turned into.
CHUNK_LINES = 4096


def validate_patches(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Each patch with the first rule it breaks, or ``ok``."""
    totals = files.select("path", read_line_count(F.col("content")).cast("bigint").alias("total"))
    start, end, total = F.col("start_line"), F.col("end_line"), F.col("total")
    ranged = F.col("action").isin("patch", "delete")
    no_content = F.col("content").isNull()
    reason = (
        F.when(total.isNull(), F.lit("file not found"))
        .when(ranged & ((start < 1) | (start > total)), F.lit("start out of range"))
        .when(ranged & (end < start), F.lit("end before start"))
        .when(ranged & (end > total), F.lit("end out of range"))
        .when((F.col("action") == "patch") & no_content, F.lit("content required"))
        .when((F.col("action") == "insert") & ((start < 0) | (start > total)), F.lit("start out of range"))
        .when((F.col("action") == "insert") & no_content, F.lit("content required"))
        .otherwise(F.lit("ok"))
    )
    return patches.join(totals, "path", "left").withColumn("reason", reason).drop("total")


def _spans(patches: DataFrame) -> DataFrame:
    """``path, seq, first, last``: the lines that each patch takes.

    An insert after line N stands at N + 1; appends take none.
    """
    is_insert = F.col("action") == "insert"
    first = F.when(is_insert, F.col("start_line") + 1).otherwise(F.col("start_line"))
    last = F.when(is_insert, F.col("start_line") + 1).otherwise(F.col("end_line"))
    return patches.where("action <> 'append'").select("path", "seq", first.alias("first"), last.alias("last"))


def patch_conflicts(patches: DataFrame) -> DataFrame:
    """Neighbouring patches of a file that overlap.

    Neighbours are found by places in one order over all files, so a file with
    most of the patches is spread over all tasks.
    """
    order = [F.col("first"), F.col("seq"), F.col("last")]
    pairs = with_next(_spans(patches), ["path"], order, {"next_seq": "seq", "next_first": "first"})
    return pairs.where(F.col("last") >= F.col("next_first")).select("path", "seq", "first", "last", "next_seq", "next_first")


def accepted_patches(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Patches of files where every patch is valid and none overlap."""
    judged = validate_patches(patches, files).groupBy("path").agg(F.bool_and(F.col("reason") == "ok").alias("_valid"))
    clashing = patch_conflicts(patches).select("path").distinct()
    clear = judged.where("_valid").join(clashing, "path", "left_anti")
    return patches.join(clear.select("path"), "path", "left_semi")


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit("\r")))


def _replaced_lines(patches: DataFrame) -> DataFrame:
    """``path, _at`` of every old line that a patch replaces or deletes, long ranges by chunks."""
    start, end = F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint")
    ranges = patches.where(F.col("action").isin("patch", "delete") & (start <= end)).select(
        "path", start.alias("_start"), end.alias("_end"), F.explode(F.sequence(start, end, F.lit(CHUNK_LINES).cast("bigint"))).alias("_from")
    )
    upto = F.least(F.col("_from") + (CHUNK_LINES - 1), F.col("_end"))
    return ranges.select("path", F.explode(F.sequence(F.col("_from"), upto)).alias("_at"))


def apply_patches(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of every patched file after its patches; ``patches`` must be accepted ones.

    Old lines that stay and new lines are rows in one order (line, replaced
    before inserted, seq, place in the patch) over all files, so neither the lines
    nor the patches of a file come together in one task, and the outcome does
    not depend on the order of the input. Appends that are equal in all columns
    are all appended, one after the other.
    """
    is_append = F.col("action") == "append"
    touched = patches.select("path").distinct()
    text = F.col("content")
    old = files.join(touched, "path", "left_semi").select(
        "path", F.posexplode(F.slice(_lines(text), F.lit(1), read_line_count(text))).alias("_pos", "line")
    )
    kept = old.select("path", (F.col("_pos") + 1).cast("bigint").alias("_at"), "line").join(
        _replaced_lines(patches), ["path", "_at"], "left_anti"
    )
    old_slot = [F.lit(v).cast(t).alias(n) for n, t, v in (("_slot", "int", 0), ("_seq", "bigint", 0), ("_key", "bigint", 0), ("_copy", "int", 0), ("_pos", "int", 0))]
    columns = ["path", "action", "start_line", "seq", "content"]
    alike = patches.where("action <> 'delete'").groupBy(*columns).agg(F.count("*").cast("int").alias("_copies"))
    copies = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    fresh = copies.select(
        "path",
        F.when(is_append, F.lit(LAST_LINE)).otherwise(F.col("start_line")).cast("bigint").alias("_at"),
        (F.col("action") == "insert").cast("int").alias("_slot"),
        F.col("seq").cast("bigint").alias("_seq"),
        F.xxhash64("content").alias("_key"),
        "_copy",
        F.posexplode(_lines(F.coalesce("content", F.lit("")))).alias("_pos", "line"),
    )
    every = kept.select("path", "_at", *old_slot, "line").unionByName(fresh)
    order = ["path", "_at", "_slot", "_seq", "_key", "_copy", "_pos"]
    placed = with_row_number(every, [F.col(c) for c in order], "_place")
    first = placed.groupBy("path").agg(F.min("_place").alias("_first"))
    return placed.join(first, "path").select("path", (F.col("_place") - F.col("_first") + 1).alias("line_no"), "line")


def lines_affected(patches: DataFrame) -> DataFrame:
    """Lines each accepted patch touches, summed per file."""
    added = F.size(F.split(F.coalesce("content", F.lit("")), "\n"))
    count = F.when(
        F.col("action").isin("patch", "delete"), F.col("end_line") - F.col("start_line") + 1
    ).otherwise(added)
    return patches.groupBy("path").agg(
        F.count("*").alias("patches"), F.sum(count).cast("bigint").alias("lines_affected")
    )


def write_mode_check(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome of writes: create needs a free path, overwrite an existing one, upsert neither."""
    present = files.select("path", F.lit(True).alias("_exists"))
    exists = F.coalesce("_exists", F.lit(False))
    error = (
        F.when((F.col("mode") == "create") & exists, F.lit("already exists"))
        .when((F.col("mode") == "overwrite") & ~exists, F.lit("does not exist"))
        .otherwise(F.lit(""))
    )
    return (
        requests.join(present, "path", "left")
        .withColumn("error", error)
        .withColumn("success", F.col("error") == "")
        .drop("_exists")
    )


def all_or_nothing(rows: DataFrame, valid: str, *batch: str) -> DataFrame:
    """Mark rows whose whole batch is valid."""
    verdict = rows.groupBy(*batch).agg(F.bool_and(valid).alias("batch_ok"))
    return rows.join(verdict, list(batch))


def plan_moves(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Errors of (batch, source, target) moves and whether the batch runs at all."""
    paths = files.select("path").distinct()
    sources = paths.select(F.col("path").alias("source"), F.lit(True).alias("_source"))
    targets = paths.select(F.col("path").alias("target"), F.lit(True).alias("_target"))
    denied = F.coalesce(write_reason(F.col("source")), write_reason(F.col("target")))
    error = (
        F.when(denied.isNotNull(), denied)
        .when(F.col("_source").isNull(), F.lit("source not found"))
        .when(F.col("_target").isNotNull(), F.lit("target exists"))
        .otherwise(F.lit(""))
    )
    checked = (
        moves.join(sources, "source", "left")
        .join(targets, "target", "left")
        .withColumn("error", error)
        .withColumn("_valid", F.col("error") == "")
        .drop("_source", "_target")
    )
    return all_or_nothing(checked, "_valid", "batch").drop("_valid").withColumnRenamed("batch_ok", "executed")


def plan_deletes(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome of deletes, each on its own: a missing file fails, a missing folder does not.

    Requests have (path, is_folder).
    """
    present = files.select("path", F.lit(True).alias("_exists")).distinct()
    denied = write_reason(F.col("path"))
    error = (
        F.when(denied.isNotNull(), denied)
        .when(~F.col("is_folder") & F.col("_exists").isNull(), F.lit("file not found"))
        .otherwise(F.lit(""))
    )
    return (
        requests.join(present, "path", "left")
        .withColumn("error", error)
        .withColumn("success", F.col("error") == "")
        .drop("_exists")
    )


def batch_outcome(results: DataFrame, *batch: str) -> DataFrame:
    """Successes, failures and lines affected per batch."""
    return results.groupBy(*batch).agg(
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum(F.when(F.col("success"), F.col("lines_affected")).otherwise(0)).cast("bigint").alias("lines_affected"),
    )


def folder_members(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files below each folder, matched on whole folder names in any case."""
    key = F.split(path_key(F.col("path")), "/")
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(key) - 1, F.lit(1))), lambda n: F.array_join(F.slice(key, 1, n), "/")
    )
    wanted = folders.select(F.rtrim(path_key(F.col("folder")), F.lit("/")).alias("_folder"), "folder")
    return (
        files.withColumn("_folder", F.explode(above)).join(wanted, "_folder").select("folder", "path")
    )
