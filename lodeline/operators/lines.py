"""Lines of files: split, grep, slice, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.text import contains_fold, number_line, split_line_count


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line, numbered from 1. The text itself is not carried along."""
    return files.select(
        *keep, F.posexplode(F.split("content", "\n")).alias("_pos", "_line")
    ).select(*keep, (F.col("_pos") + 1).alias("line_no"), F.rtrim(F.col("_line"), F.lit("\r")).alias("line"))


def grep(files: DataFrame, query: str, *keep: str) -> DataFrame:
    """Lines that contain ``query`` in any case, each with its numbered form.

    Files without a hit are dropped before their text is split.
    """
    candidates = files.where(contains_fold(F.col("content"), query))
    return explode_lines(candidates, *keep).where(contains_fold(F.col("line"), query)).withColumn(
        "shown", number_line(F.col("line_no"), F.col("line"))
    )


def grep_counts(files: DataFrame, query: str, *keep: str) -> DataFrame:
    """Matching lines and all lines per file that has a match. No shuffle."""
    hit = F.filter(F.split("content", "\n"), lambda line: contains_fold(line, query))
    return (
        files.where(contains_fold(F.col("content"), query))
        .select(
            *keep,
            F.size(hit).alias("match_count"),
            split_line_count(F.col("content")).alias("total_lines"),
        )
        .where("match_count > 0")
    )


def check_range(start: int | None, end: int | None, query: str | None = None) -> None:
    if query is not None and (start is not None or end is not None):
        raise ValueError("query and a line range exclude each other")
    if (start is None) != (end is None):
        raise ValueError("start and end go together")
    if start is not None and end is not None:
        if start < 1 or end < 1:
            raise ValueError("start and end must be at least 1")
        if start > end:
            raise ValueError("start must not be after end")


def line_range(files: DataFrame, start: int, end: int, *keep: str) -> DataFrame:
    """Lines start..end of every file that reaches ``start``; ``end`` is held to the file."""
    check_range(start, end)
    total = split_line_count(F.col("content"))
    part = F.slice(F.split("content", "\n"), start, end - start + 1)
    return (
        files.where(total >= start)
        .select(
            *keep,
            total.alias("total_lines"),
            F.least(F.lit(end), total).alias("end_line"),
            F.posexplode(part).alias("_pos", "_line"),
        )
        .select(
            *keep,
            "total_lines",
            "end_line",
            (F.col("_pos") + start).alias("line_no"),
            F.rtrim(F.col("_line"), F.lit("\r")).alias("line"),
        )
    )


def number_lines(files: DataFrame, *keep: str) -> DataFrame:
    """Every line in its numbered form."""
    return explode_lines(files, *keep).select(
        *keep, "line_no", number_line(F.col("line_no"), F.col("line")).alias("shown")
    )


def slice_body(content: Column, start: Column, end: Column) -> dict[str, Column]:
    """Lines start..end of a text, and what follows the first line that ends in ``{``."""
    lines = F.split(content, "\n")
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    part = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    opens = F.transform(part, lambda line: F.rtrim(line, F.lit(" \t\r")).endswith("{"))
    at = F.array_position(opens, F.lit(True))
    return {
        "full_code": F.array_join(part, "\n"),
        "body": F.when(at > 0, F.array_join(F.slice(part, (at + 1).cast("int"), F.size(part)), "\n")).otherwise(
            F.lit("")
        ),
    }
