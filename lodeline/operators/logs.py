"""Compiler and package-tool logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.text import GROUP, contains_fold

# Fixed value: format of a compiler diagnostic.
DIAGNOSTIC = r"(?id)^(.+?)\((\d+),(\d+)\):\s*(error|warning)\s+(\w+):\s*(.+?)(?:\s+\[.+\])?$"

SPACE = " \t\r\n\f\u000b\u0085\u00a0\u2028\u2029"


def parse_diagnostics(log: DataFrame, *keep: str, line: str = "line") -> DataFrame:
    """Diagnostics found in log lines; other lines are dropped.

    A line holds one at most, so each is matched once and cut once.
    """
    text = F.translate(F.trim(F.col(line), F.lit(SPACE)), GROUP, "\ufffd")
    part = lambda i: F.get("_part", F.lit(i - 1))
    file = F.ltrim(F.replace(F.trim(part(1)), F.lit("\\"), F.lit("/")), F.lit("/"))
    marks = GROUP.join(f"${i}" for i in range(1, 7))
    # most lines of a log are dropped by a plain substring test
    likely = log.where(F.contains(F.col(line), F.lit("):")))
    cut = likely.select(*keep, F.split(F.regexp_replace(text, DIAGNOSTIC, marks), GROUP).alias("_part"))
    return cut.where("size(_part) = 6").select(
        *keep,
        F.lower(part(4)).alias("severity"),
        part(5).alias("code"),
        file.alias("file"),
        F.coalesce(part(2).try_cast("int"), F.lit(-1)).alias("line"),
        F.coalesce(part(3).try_cast("int"), F.lit(-1)).alias("col"),
        F.trim(part(6)).alias("message"),
    )


def dedupe_diagnostics(diagnostics: DataFrame, *order: str) -> DataFrame:
    """First diagnostic per (file, line, code) in input order."""
    rest = [c for c in diagnostics.columns if c not in ("file", "line", "code")]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("d")
    return diagnostics.groupBy("file", "line", "code").agg(first).select(
        "file", "line", "code", *[f"d.{c}" for c in rest]
    )


def severity_filter(diagnostics: DataFrame, include_warnings: bool = False) -> DataFrame:
    return diagnostics if include_warnings else diagnostics.where("severity = 'error'")


def build_summary(diagnostics: DataFrame, *keys: str) -> DataFrame:
    """Errors, warnings and the verdict of a build; the exit code plays no part."""
    errors = F.count_if(F.col("severity") == "error")
    warnings = F.count_if(F.col("severity") == "warning")
    counted = diagnostics.groupBy(*keys).agg(errors.alias("errors"), warnings.alias("warnings"))
    return counted.withColumn("success", F.col("errors") == 0).withColumn(
        "summary", build_line(F.col("errors"), F.col("warnings"))
    )


def build_line(errors: Column, warnings: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.when(
        errors == 0,
        F.concat(F.lit("Build succeeded — 0 errors, "), text(warnings), F.lit(" warning(s)")),
    ).otherwise(
        F.concat(
            F.lit("Build FAILED — "), text(errors), F.lit(" error(s), "), text(warnings), F.lit(" warning(s)")
        )
    )


def package_log_ok(output: Column) -> Column:
    return ~(contains_fold(output, "error") | contains_fold(output, "unrecognized"))


def parse_package_log(logs: DataFrame, *keep: str, output: str = "output") -> DataFrame:
    """Error and warning lines of failed package runs."""
    return (
        logs.where(~package_log_ok(F.col(output)))
        .select(*keep, F.posexplode(F.split(output, "\n")).alias("_pos", "_line"))
        .select(*keep, (F.col("_pos") + 1).alias("line_no"), F.trim(F.col("_line"), F.lit(SPACE)).alias("message"))
        .where(contains_fold(F.col("message"), "error") | contains_fold(F.col("message"), "warn"))
        .withColumn(
            "severity",
            F.when(contains_fold(F.col("message"), "error"), F.lit("error")).otherwise(F.lit("warning")),
        )
    )
