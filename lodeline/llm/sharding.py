"""Sharding: a shuffle that can be computed, from a Feistel network over row numbers.

Rows are numbered, and the number goes through a keyed permutation of all
numbers. A balanced Feistel network permutes the next power of four; a result
outside is sent through again until it is inside (cycle walking), so it permutes
exactly the rows there are. A position gives the shard and the slot by division,
and the inverse gives the row number back, without any table.

Defined cases: a null text has no bytes, a null or repeated id is a value like
any other, equal rows get places of their own, no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import before_within, part_count

SHARDS = 40
SEED = 42
ROUNDS = 6
# Bytes that a row takes besides its text.
ROW_BYTES = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, ROUNDS, dtype=np.uint64)


def _half(rows: int) -> int:
    """Bits of one half of the smallest power of four that holds the rows."""
    return max(1, -(-max(1, rows - 1).bit_length() // 2))


def _round(half: np.ndarray, key: np.uint64, bits: int) -> np.ndarray:
    mixed = (half + key) * _ODD
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD
    return (mixed >> np.uint64(29)) & np.uint64((1 << bits) - 1)


def _network(values: np.ndarray, rows: int, seed: int, back: bool) -> np.ndarray:
    bits = _half(rows)
    mask = np.uint64((1 << bits) - 1)
    left, right = values >> np.uint64(bits), values & mask
    keys = _keys(seed)
    if back:
        for key in keys[::-1]:
            left, right = right ^ _round(left, key, bits), left
    else:
        for key in keys:
            left, right = right, left ^ _round(right, key, bits)
    return (left << np.uint64(bits)) | right


def permute(values: np.ndarray, rows: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Positions of row numbers, each below ``rows``; ``back`` gives numbers of positions."""
    out = np.asarray(values).astype(np.uint64)
    with np.errstate(over="ignore"):
        walk = np.arange(len(out))
        while len(walk):
            out[walk] = _network(out[walk], rows, seed, back)
            walk = walk[out[walk] >= rows]
    return out.astype(np.int64)


def locate(row_no: np.ndarray, rows: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    position = permute(row_no, rows, seed)
    return position % shards, position // shards


def row_at(shard: np.ndarray, slot: np.ndarray, rows: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Row numbers of places: the other way round than ``locate``."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), rows, seed, back=True)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """Add ``row_no`` from 0, in the order of a hash of all columns.

    Equal rows are counted before they are ordered and spread out after it, so
    they cannot fill a part.
    """
    columns = rows.columns
    parts = part_count(total)
    hashed = F.xxhash64(*columns)
    counted = (
        rows.groupBy(*columns).agg(F.count("*").alias("_copies"))
        .withColumn("_hash", hashed)
        .withColumn("_part", F.shiftrightunsigned("_hash", 64 - (parts.bit_length() - 1)))
    )
    order = [F.col("_hash"), *[F.col(c) for c in columns]]
    started = before_within(counted, [], "_part", "_copies", order, "_start")
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))
    return started.select(*columns, "_start", copy.alias("_copy")).select(
        *columns, (F.col("_start") + F.col("_copy")).alias("row_no")
    )


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, row_no, shard, slot``: shards differ by one row at most."""
    total = docs.count()

    @F.pandas_udf("bigint")
    def position(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), total, seed))

    placed = numbered(measured(docs), total).withColumn("_position", position("row_no"))
    shard, slot = F.col("_position") % shards, F.expr(f"_position div {shards}")
    return placed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("bigint")}).drop("_position")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Documents as one folder per shard, each in the order of its slots."""
    copy = F.row_number().over(_copies())
    placed = assign(docs, shards, seed).withColumn("_copy", copy)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns(
        {"size": (F.octet_length(text) + ROW_BYTES).cast("bigint"), "text_crc32": F.crc32(text.cast("binary"))}
    ).withColumn("_copy", copy)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "size", "text_crc32", "_copy")]
    joined = keyed.alias("a").join(placed.alias("b"), same).select(*[f"a.`{c}`" for c in docs.columns], "b.shard", "b.slot")
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _copies():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "size", "text_crc32").orderBy(F.lit(0))
