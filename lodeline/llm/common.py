"""What the operators of this package share: batches, sessions, prefix sums."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeline.session import settle, shared_dir

# White space between words: space and the control characters 9 to 13.
GAP = r"[\x20\x09-\x0D]+"

# Rows of one Arrow batch; Spark also ends a batch at its own limit of bytes.
BATCH_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the session that these operators count on."""
    settle(spark)
    # A join on a key and more stays where rows were dealt out by that key.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """An unused folder below the one that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: read many times, made once."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return ["" if v is None else v for v in column.to_pylist()]


def n_words(text: str | Column) -> Column:
    """Number of words of a text, null counts none.

    Every word but the first follows a gap, so the gaps of the trimmed text are
    counted by what squeezing them to one character leaves.
    """
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), GAP, " "))
    spaces = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return F.when(squeezed == "", F.lit(0)).otherwise(spaces + 1).cast("bigint")


def part_count(rows: int, part_rows: int = 16_384, least: int = 512) -> int:
    """A power of two of parts, so that a part of an even spread holds about ``part_rows`` at most."""
    return max(least, 1 << (-(-rows // part_rows) - 1).bit_length())


def before_within(df: DataFrame, keys: list[str], part: str, weight: str, order: list[Column], out: str) -> DataFrame:
    """Sum of ``weight`` over the rows that come before, by (part, order) within ``keys``.

    ``part`` is a whole number that cuts every group of ``keys`` into ordered
    parts of bounded size. Windows run inside a part, and over one row per part,
    so a group with most of the rows is spread over all tasks. Keys and part are
    not null; rows that tie in ``order`` count as coming in any order.
    """
    on = [*keys, part]
    over = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*on).agg(F.sum(weight).alias("_part_sum"))
    starts = sums.select(*on, F.coalesce(F.sum("_part_sum").over(over), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(starts, on).withColumn(out, F.col("_part_start") + F.col("_inside")).drop("_part_start", "_inside")


def quiet_tokenizers() -> None:
    """One thread per task: Spark runs the tasks side by side already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
