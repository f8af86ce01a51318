"""Projects and their environments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PROJECTS = 10


def load_registry(projects: DataFrame) -> DataFrame:
    """Enabled projects, the only ones that can be searched."""
    return projects.where("enabled")


def add_requests(registry: DataFrame, requests: DataFrame, limit: int | None = MAX_PROJECTS) -> DataFrame:
    """Every request with its ``outcome``: added, name taken, asked before, or registry full.

    Requests have (id, name, seq) and are taken in the order of ``seq``. A name
    counts in any case; ``limit`` None is no limit. Only requests that could
    still find room are put in order.
    """
    key = F.lower("name")
    first = requests.groupBy(key.alias("_key")).agg(F.min("seq").alias("_first"))
    taken = registry.select(key.alias("_key"), F.lit(True).alias("_taken")).distinct()
    judged = requests.withColumn("_key", key).join(first, "_key").join(taken, "_key", "left")
    fits = F.lit(True)
    if limit is not None:
        room = limit - registry.limit(limit).count()
        free = first.join(taken, "_key", "left_anti").orderBy("_first").limit(max(room, 1))
        last = free.agg(F.max("_first")).first()[0] if room > 0 else None
        fits = F.lit(False) if last is None else F.col("seq") <= last
    outcome = (
        F.when(F.col("_taken"), "name taken").when(F.col("seq") != F.col("_first"), "asked before")
        .when(~fits, "registry full").otherwise("added")
    )
    return judged.withColumn("outcome", outcome).drop("_key", "_first", "_taken")


def registry_add(registry: DataFrame, requests: DataFrame, limit: int | None = MAX_PROJECTS) -> DataFrame:
    """Registry after adding the requests that ``add_requests`` grants."""
    added = add_requests(registry, requests, limit).where("outcome = 'added'")
    return registry.unionByName(added.select(*registry.columns))


def registry_update(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Registry after renames by id; a name another project holds is refused.

    ``updates`` has one (id, name, enabled) row per project.
    """
    owners = registry.select(F.lower("name").alias("_key"), F.col("id").alias("_owner"))
    allowed = (
        updates.withColumn("_key", F.lower("name"))
        .join(owners, "_key", "left")
        .where(F.col("_owner").isNull() | (F.col("_owner") == F.col("id")))
        .select("id", F.col("name").alias("_name"), F.col("enabled").alias("_enabled"))
    )
    return registry.join(allowed, "id", "left").select(
        "id",
        F.coalesce("_name", "name").alias("name"),
        F.coalesce("_enabled", "enabled").alias("enabled"),
    )


def registry_semi(rows: DataFrame, registry: DataFrame, on: str) -> DataFrame:
    """Rows of projects that are still enabled."""
    return rows.join(load_registry(registry).select(on), on, "left_semi")


def default_environment(environments: DataFrame, project: str = "project_id") -> DataFrame:
    """The flagged environment of each project, else its first."""
    place = F.struct((~F.col("is_default")).alias("later"), "seq")
    return environments.groupBy(project).agg(
        F.min_by("name", place).alias("environment"), F.min(place)["seq"].alias("seq")
    )


def named_environment(environments: DataFrame, requests: DataFrame, project: str = "project_id") -> DataFrame:
    """The environment each request names, or the default when it names none."""
    wanted = requests.select(project, F.lower("environment").alias("_key"), "environment")
    blank = F.coalesce(F.trim("environment"), F.lit("")) == ""
    named = wanted.where(~blank).join(
        environments.select(project, F.lower("name").alias("_key"), "name"), [project, "_key"]
    ).select(project, "environment", "name")
    default = default_environment(environments, project).withColumnRenamed("environment", "name")
    return named.unionByName(
        wanted.where(blank).join(default, project).select(project, "environment", "name")
    )


def promote_after_delete(environments: DataFrame, deleted: DataFrame, project: str = "project_id") -> DataFrame:
    """Environments left after deletes; a project that lost its default promotes its first."""
    left = environments.join(deleted.select(project, "name"), [project, "name"], "left_anti")
    lost = environments.where("is_default").join(deleted.select(project, "name"), [project, "name"], "left_semi")
    lost = lost.select(project, F.lit(True).alias("_lost")).distinct()
    first = left.groupBy(project).agg(F.min("seq").alias("_first"))
    return (
        left.join(first, project)
        .join(lost, project, "left")
        .withColumn(
            "is_default", F.col("is_default") | (F.col("_lost").isNotNull() & (F.col("seq") == F.col("_first")))
        )
        .drop("_first", "_lost")
    )


def settle_defaults(environments: DataFrame, project: str = "project_id") -> DataFrame:
    """One default per project after adding in order: the last one flagged, else the first."""
    chosen = environments.groupBy(project).agg(
        F.coalesce(F.max(F.when(F.col("is_default"), F.col("seq"))), F.min("seq")).alias("_chosen")
    )
    return (
        environments.join(chosen, project)
        .withColumn("is_default", F.col("seq") == F.col("_chosen"))
        .drop("_chosen")
    )


def registry_stats(projects: DataFrame, environments: DataFrame, project: str = "project_id") -> DataFrame:
    """Projects, enabled ones, environments and those with authentication, per project and in all."""
    per_project = environments.groupBy(project).agg(
        F.count("*").alias("environments"),
        F.count_if(F.col("auth_type") != "None").alias("with_auth"),
    )
    return projects.join(per_project, project, "left").agg(
        F.count("*").alias("projects"),
        F.count_if("enabled").alias("enabled"),
        F.coalesce(F.sum("environments"), F.lit(0)).alias("environments"),
        F.coalesce(F.sum("with_auth"), F.lit(0)).alias("with_auth"),
    )
