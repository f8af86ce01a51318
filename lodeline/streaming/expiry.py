"""Expiry of stored entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.streaming.changes import clocked, session


def live_entries(writes: DataFrame, keys: list[str], at: str, ttl: int, now: int) -> DataFrame:
    """Entries that still live at ``now``: an entry lives ``ttl`` from its last write."""
    return (
        writes.where(F.col(at) <= now)
        .groupBy(*keys)
        .agg(F.max(at).alias("last_write"))
        .withColumn("expires_at", F.col("last_write") + ttl)
        .where(F.col("expires_at") > now)
    )


def expirations(writes: DataFrame, keys: list[str], at: str, ttl: int, ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Lives of the entries of a stream of writes, given out when they end: ``created_at, expires_at, writes``.

    ``at`` and ``ttl`` count microseconds. Every write renews an entry, so its life
    is a session that the state store of the query holds and that ends when the
    watermark passes its expiry; ``ticks`` ends lives when no write comes (see
    ``changes.clocked``).
    """
    return (
        clocked(writes, at, ticks, delay)
        .groupBy(*keys, session(ttl).alias("_life"))
        .agg(F.min(at).alias("created_at"), (F.max(at) + ttl).alias("expires_at"), F.count("*").alias("writes"))
        .drop("_life")
    )


def joined_lives(rows: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Lives (first, last, n) joined where one begins less than ``ttl`` after another's last access.

    Accesses in one slot of length ``ttl`` are always that close, so lives are
    found on one row per slot, and a key with most of the accesses has at most
    one row per slot in time. A row stands in the slot of its last access.
    """
    slots = (
        rows.groupBy(*keys, F.floor(F.col("last") / ttl).cast("bigint").alias("_slot"))
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    )
    by_key = Window.partitionBy(*keys).orderBy("_slot")
    gap = F.col("first") - F.lag("last").over(by_key)
    placed = slots.withColumn("_starts", F.when(F.coalesce(gap, F.lit(ttl)) >= ttl, F.col("_slot")))
    life = F.max("_starts").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumn("_life", life)
        .groupBy(*keys, "_life")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .drop("_life")
    )


def sliding_lives(accesses: DataFrame, keys: list[str], at: str, sliding: int) -> DataFrame:
    """Lives of entries that every access renews by ``sliding``: one row per life."""
    rows = accesses.select(*keys, F.col(at).alias("first"), F.col(at).alias("last"), F.lit(1).alias("n"))
    return joined_lives(rows, keys, sliding).select(
        *keys, F.col("first").alias("created"), (F.col("last") + sliding).alias("expires"), F.col("n").alias("accesses")
    )
