"""Project manifests in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = r"<PackageReference\b[^>]*>"


def _attribute(element: Column, name: str) -> Column:
    found = F.regexp_extract(element, rf'\b{name}\s*=\s*"([^"]*)"', 1)
    return F.when(F.rlike(element, F.lit(rf'\b{name}\s*=\s*"')), found).otherwise(F.lit("Unknown"))


def manifest_facts(content: Column) -> dict[str, Column]:
    """SDK and target framework: the single form, else the plural one, else ``Unknown``."""
    single = r"(?s)<TargetFramework>(.*?)</TargetFramework>"
    plural = r"(?s)<TargetFrameworks>(.*?)</TargetFrameworks>"
    return {
        "sdk": _attribute(F.regexp_extract(content, r"(<Project\b[^>]*>)", 1), "Sdk"),
        "framework": F.when(F.rlike(content, F.lit(single)), F.regexp_extract(content, single, 1))
        .when(F.rlike(content, F.lit(plural)), F.regexp_extract(content, plural, 1))
        .otherwise(F.lit("Unknown")),
    }


def scan_manifests(files: DataFrame) -> DataFrame:
    """One row per package reference; a manifest without any gives one row with no package."""
    facts = manifest_facts(F.col("content"))
    return (
        files.select(
            "project",
            "path",
            *[c.alias(n) for n, c in facts.items()],
            F.explode_outer(F.regexp_extract_all(F.col("content"), F.lit(REFERENCE), F.lit(0))).alias("_ref"),
        )
        .withColumn("package", F.when(F.col("_ref").isNotNull(), _attribute(F.col("_ref"), "Include")))
        .withColumn("version", F.when(F.col("_ref").isNotNull(), _attribute(F.col("_ref"), "Version")))
        .drop("_ref")
    )


def package_usage(files: DataFrame) -> DataFrame:
    """Packages per manifest."""
    references = F.regexp_extract_all(F.col("content"), F.lit(REFERENCE), F.lit(0))
    return files.select("project", "path", F.size(references).alias("packages"))


def manifests_per_package(files: DataFrame) -> DataFrame:
    """How many manifests refer to each package."""
    return (
        scan_manifests(files)
        .where("package is not null")
        .select("package", "project", "path")
        .distinct()
        .groupBy("package")
        .agg(F.count("*").alias("manifests"))
    )
