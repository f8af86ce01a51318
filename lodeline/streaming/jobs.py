"""Runnable streaming jobs around the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodeline.operators.policy import enabled_only
from lodeline.session import cut_lineage, settle
from lodeline.sources.index import read_touched, rewrite_touched, write_index
from lodeline.streaming.changes import apply_changes, change_feed, drain_triggers, latest_per_key, quiet_bursts


def run_to_sink(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there into a Parquet folder and stop."""
    settle(stream.sparkSession)
    return (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def drain_job(names: DataFrame, registry: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Projects that a queue of names asks for: each once per batch, so a later request counts again."""
    settle(names.sparkSession)

    def step(batch: DataFrame, batch_id: int) -> None:
        drain_triggers(batch, registry).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return names.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_job(
    events: DataFrame, ticks: DataFrame, root: str, checkpoint: str, schema: T.StructType,
    load: Callable[[DataFrame], DataFrame], gap: int, delay: str = "10 minutes",
) -> StreamingQuery:
    """Feed, debounce per path and upkeep as one job over (project, path, old_path, action, ts, seq) events.

    ``ts`` counts microseconds. Changes that have been quiet for ``gap``, by the
    events or by the clock of ``ticks``, go to the stored index, which takes every
    file as it is by then.
    """
    feed = change_feed(events.withColumn("ts", F.struct("ts", "seq"))).select("project", "path", "action", "ts.ts", "ts.seq")
    quiet = quiet_bursts(feed, ["project", "path"], "ts", gap, "seq", ticks, delay)
    return index_upkeep(quiet, root, checkpoint, schema, load, ["project", "path"], ["ts", "seq", "action"])


def upkeep_step(
    batch: DataFrame, root: str, schema: T.StructType, load: Callable[[DataFrame], DataFrame],
    keys: list[str], order: list[str],
) -> None:
    """Bring the stored index up to date with a batch of changes; a repeated one gives the same rows."""
    spark = batch.sparkSession
    latest = cut_lineage(latest_per_key(batch, keys, order))
    if latest.isEmpty():
        return
    held = read_touched(spark, root, schema, latest)
    after = apply_changes(held, latest, load(latest.select(*keys)), keys, order)
    rewrite_touched(after, root, latest)


def index_upkeep(
    changes: DataFrame,
    root: str,
    checkpoint: str,
    schema: T.StructType,
    load: Callable[[DataFrame], DataFrame],
    keys: list[str],
    order: list[str],
) -> StreamingQuery:
    """Apply a stream of changes to the stored index, batch by batch.

    ``load`` gives the current files for a frame of keys. Only the buckets a
    batch touches are read and rewritten; a batch that is repeated gives the same
    rows again, because every changed file is taken as it is now.
    """

    settle(changes.sparkSession)

    def step(batch: DataFrame, batch_id: int) -> None:
        upkeep_step(batch, root, schema, load, keys, order)

    return (
        changes.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def full_pass(
    files: DataFrame, registry: DataFrame, root: str, build: Callable[[DataFrame], DataFrame]
) -> None:
    """Index every file of the enabled projects anew. Meant to be run by a scheduler each hour.

    An enabled project without files is emptied.
    """
    projects = registry.where("enabled").select(F.col("name").alias("project"))
    write_index(build(enabled_only(files, registry)), root, projects)
