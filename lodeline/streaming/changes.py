"""The change feed: normalise, debounce, apply. Works on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.policy import WATCH_DIRS, extension, not_excluded_dir


def change_feed(events: DataFrame, ext: str = ".cs") -> DataFrame:
    """Upserts and deletes from (project, path, old_path, action, ts) events.

    A rename deletes the old path and upserts the new one. Upserts in excluded
    folders are left out; deletes are kept wherever they are.
    """
    path, gone = F.col("path"), F.col("old_path")
    step = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("path"))
    steps = (
        F.when(F.col("action").isin("created", "changed"), F.array(step("upsert", path)))
        .when(F.col("action") == "deleted", F.array(step("delete", path)))
        .when(F.col("action") == "renamed", F.array(step("delete", gone), step("upsert", path)))
    )
    rows = events.withColumn("_step", F.explode(steps)).select(
        "project", "_step.path", "_step.action", "ts"
    )
    watched = extension(F.col("path")) == ext
    return rows.where(
        watched & ((F.col("action") == "delete") | not_excluded_dir(F.col("path"), WATCH_DIRS))
    )


def debounce(changes: DataFrame, keys: list[str], at: str, gap: int, tie: Column) -> DataFrame:
    """Last change of every burst: the next one of its key is ``gap`` or more away.

    ``at`` is a bigint time in the unit of ``gap``; ``tie`` orders equal times.
    Two changes in the same slot of length ``gap`` are always closer than that,
    so only the last one of a slot can stand, and only the first one of the next
    slot can replace it. One aggregation per slot is enough: no key is ever
    sorted or held as a whole.
    """
    columns = changes.columns
    slots = (
        changes.withColumn("_slot", F.floor(F.col(at) / gap).cast("bigint"))
        .groupBy(*keys, "_slot")
        .agg(
            F.max_by(F.struct(*columns), F.struct(F.col(at), tie)).alias("_last"),
            F.min(at).alias("_first"),
        )
    )
    following = slots.select(*keys, (F.col("_slot") - 1).alias("_slot"), F.col("_first").alias("_next"))
    return (
        slots.join(following, [*keys, "_slot"], "left")
        .where(F.col("_next").isNull() | (F.col("_next") - F.col(f"_last.{at}") >= gap))
        .select("_last.*")
    )


def debounce_stream(changes: DataFrame, keys: list[str], gap: str, delay: str, tie: str, *carry: str) -> DataFrame:
    """The same on a stream without an end: a burst is emitted once the watermark has passed its gap.

    What is open when the input goes quiet waits for more input; where it must
    not, use ``quiet_bursts``.
    """
    return (
        changes.withWatermark("ts", delay)
        .groupBy(*keys, F.session_window("ts", gap).alias("burst"))
        .agg(
            F.max("ts").alias("ts"),
            F.max_by(F.struct(*carry), F.struct("ts", tie)).alias("_last"),
            F.count("*").alias("changes"),
        )
        .select(*keys, "ts", "changes", *[f"_last.{c}" for c in carry])
    )


def clocked(rows: DataFrame, at: str, ticks: DataFrame, delay: str) -> DataFrame:
    """Rows of a stream with the time ``_ts``, whose watermark also follows a clock.

    ``at`` counts microseconds. ``ticks`` is a stream of (at bigint), the same
    count, from whatever goes on when the rows do not: a rate source, or files that
    a scheduler writes. Ticks move the watermark and go no further. Rows without a
    time are left out, and so are those that come later than ``delay`` behind the
    watermark; Spark counts the latter in the progress of the query.
    """
    timed = rows.withColumns({"_ts": F.timestamp_micros(at), "_tick": F.lit(False)})
    clock = ticks.select(F.timestamp_micros("at").alias("_ts"), F.lit(True).alias("_tick"))
    marked = timed.unionByName(clock, allowMissingColumns=True).withWatermark("_ts", delay)
    # A condition on the time stays above the watermark, which so sees the ticks.
    return marked.where(F.when(F.col("_ts").isNotNull(), ~F.col("_tick"))).drop("_tick")


def session(gap: int) -> Column:
    """Rows of ``_ts`` less than ``gap`` microseconds from the next; the engine joins rows up to the gap it is given."""
    return F.session_window("_ts", f"{gap - 1} microseconds")


def quiet_bursts(
    changes: DataFrame, keys: list[str], at: str, gap: int, tie: str, ticks: DataFrame, delay: str = "10 minutes"
) -> DataFrame:
    """``debounce`` on a stream: the last change of every burst, once the watermark has passed its gap.

    ``at`` and ``gap`` (2 or more) count microseconds, ``tie`` orders equal times.
    Open bursts are sessions in the state store of the query, merged before the
    shuffle; ``ticks`` ends the last ones when the input goes quiet (see ``clocked``).
    """
    last = F.max_by(F.struct(*changes.columns), F.struct(at, tie)).alias("_last")
    return clocked(changes, at, ticks, delay).groupBy(*keys, session(gap).alias("_burst")).agg(last).select("_last.*")


def latest_per_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[f"_last.{c}" for c in rest])


def apply_changes(
    index: DataFrame, changes: DataFrame, files: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Index after the changes of each key.

    Every changed file is taken as it is now, whatever the change was: one that
    has gone is removed, one that is there is stored. So a delete that comes late
    removes nothing that exists. ``files`` has the same columns as ``index``.
    """
    changed = latest_per_key(changes, keys, order).select(*keys)
    return index.join(changed, keys, "left_anti").unionByName(files.join(changed, keys, "left_semi"))


def drain_triggers(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Queued project names, each once in any case, that are registered and enabled."""
    queued = names.select(F.lower("name").alias("_key")).dropDuplicates(["_key"])
    active = registry.where("enabled").select(F.lower("name").alias("_key"), F.col("name").alias("project"))
    return queued.join(active, "_key").select("project")
