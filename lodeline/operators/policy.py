"""Access verdicts and filters over a file table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions import policy as P
from lodeline.functions.text import cutoff_value


def access_verdict(files: DataFrame, path: str = "path") -> DataFrame:
    """Whether each file may be read, and the first rule it breaks."""
    reason = P.read_reason(F.col(path))
    return files.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn(
        "allowed", F.col("reason") == "ok"
    )


def write_verdict(files: DataFrame, path: str = "path") -> DataFrame:
    reason = P.write_reason(F.col(path))
    return files.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn(
        "allowed", F.col("reason") == "ok"
    )


def exclude_tests(files: DataFrame, include_tests: bool = False, path: str = "path") -> DataFrame:
    return files if include_tests else files.where(~P.is_test_path(F.col(path)))


def project_filter(df: DataFrame, project: str, column: str = "project") -> DataFrame:
    """``*`` keeps every project; an unknown one gives no rows."""
    return df if project == "*" else df.where(F.col(column) == project)


def enabled_only(df: DataFrame, registry: DataFrame, column: str = "project") -> DataFrame:
    """Rows of projects that are registered and enabled."""
    active = registry.where("enabled").select(F.col("name").alias(column))
    return df.join(active, column, "left_semi")


def changed_since(files: DataFrame, cutoff: str, column: str = "modified_at") -> DataFrame:
    """Files modified strictly after the cutoff (unix seconds or ISO-8601, UTC)."""
    limit = cutoff_value(cutoff)
    if dict(files.dtypes)[column] == "timestamp":
        return files.where(F.col(column) > limit)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), limit.cast("timestamp_ntz"))
    return files.where(F.col(column) > utc)
