"""Row numbers, neighbours and pages over a whole ordering.

A window without partition keys, or one over a key that holds a third of the
rows, puts its input into one task. These operators sort by range instead: the
ordering ends in unique columns, so the ranges are even whatever the keys are.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeline.session import cut_lineage

# Places up to this one are found by a tree of top-k steps. It is also where Spark
# stops cutting groups before it shuffles them (windowGroupLimitThreshold).
NEAR_ROWS = 1000
TREE_WIDTH = 64
# Bounds of a page and what stands for a size outside them; all can be given by the caller.
LARGEST_PAGE = 200
DEFAULT_PAGE = 50
_POSITION_BITS = 33


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Exact 1-based place of every row in the whole ordering.

    ``order`` must end in columns that make rows distinct. The sorted rows are
    written once to the shared folder, so both readers below see the same
    ranges; the place is the place in the range plus the size of the ranges
    before it, and that last table has one row per range.
    """
    marked = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = marked.withColumn("_range", F.shiftright("_id", _POSITION_BITS))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    place = F.col("_id") - F.shiftleft(F.col("_range"), _POSITION_BITS) + F.col("_start") + 1
    return (
        rows.join(F.broadcast(starts), "_range")  # one row per range
        .withColumn(name, place.cast("bigint"))
        .drop("_id", "_range", "_start")
    )


def with_next(
    df: DataFrame, keys: list[str], order: list[Column], carry: dict[str, str]
) -> DataFrame:
    """Add columns of the next row with the same keys; null on the last row.

    Works as ``lead`` does, by joining each place with the place after it. The
    join key is unique, so a hot key is spread over all tasks.
    """
    numbered = with_row_number(df, [F.col(k) for k in keys] + order, "_place")
    following = numbered.select(
        (F.col("_place") - 1).alias("_place"),
        *[F.col(k).alias(f"_next_{k}") for k in keys],
        *[F.col(source).alias(name) for name, source in carry.items()],
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_next_{k}"))
    joined = numbered.join(following, "_place", "left")
    return joined.select(
        *[F.col(c) for c in df.columns], *[F.when(same, F.col(n)).alias(n) for n in carry]
    )


def page_bounds(total: int, page: int, size: int) -> tuple[int, int]:
    """Page held to the pages there are, and their number; at least one page."""
    pages = max(1, ceil(total / size))
    return min(max(page, 1), pages), pages


def least_rows(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """The first ``rows`` rows of the ordering, for up to ``NEAR_ROWS`` of them.

    Every task keeps so many rows, groups of ``TREE_WIDTH`` tasks keep so many of
    those, and only what the groups keep comes together.
    """
    if not 0 < rows <= NEAR_ROWS:
        raise ValueError(f"rows must be between 1 and {NEAR_ROWS}")
    group = F.floor(F.spark_partition_id() / TREE_WIDTH)
    place = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    kept = df.withColumn("_group", group).withColumn("_place", place).where(F.col("_place") <= rows)
    return kept.drop("_group", "_place").orderBy(*order).limit(rows)


def take_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of the ordering: near ones from the tree, others from exact row numbers."""
    skip = (page - 1) * size
    if skip + size <= NEAR_ROWS:
        return least_rows(df, order, skip + size).orderBy(*order).offset(skip)
    place = F.col("_place")
    return (
        with_row_number(df, order, "_place")
        .where((place > skip) & (place <= skip + size))
        .drop("_place")
    )


def counted_page(df: DataFrame, order: list[Column], page: int, size: int, hold: bool) -> tuple[DataFrame, int, int]:
    """Rows of a page, its number and the number of all rows, from one reading of ``df``.

    With ``hold`` a page past the end is the last one, which takes a second
    reading. A page is as small as its size, so its rows go by the driver.
    """
    skip = (page - 1) * size
    if skip + size > NEAR_ROWS:
        numbered = with_row_number(df, order, "_place")
        total = numbered.count()
        if hold:
            page = page_bounds(total, page, size)[0]
        place = F.col("_place")
        rows = numbered.where((place > (page - 1) * size) & (place <= page * size)).drop("_place")
        return rows, page, total
    seen = Observation()
    rows = least_rows(df.observe(seen, F.count("*").alias("total")), order, skip + size).collect()[skip:]
    total = seen.get["total"]
    if hold and page > page_bounds(total, page, size)[1]:
        page = page_bounds(total, page, size)[0]
        rows = take_page(df, order, page, size).collect()
    return df.sparkSession.createDataFrame(rows, df.schema), page, total


def page_size(size: int, largest: int, clamp: bool, otherwise: int | None = None) -> int:
    """The size to use: one out of bounds fails unless ``clamp`` is set, or is ``otherwise``."""
    if 1 <= size <= largest:
        return size
    if otherwise is not None and clamp:
        return otherwise
    if not clamp:
        raise ValueError(f"a page has 1 to {largest} rows, not {size}")
    return min(max(size, 1), largest)


def page_clamped(
    df: DataFrame, order: list[Column], page: int = 1, size: int = 20, largest: int = LARGEST_PAGE, clamp: bool = True
) -> DataFrame:
    """Size held to 1 and ``largest``, page held to the pages there are."""
    size = page_size(size, largest, clamp)
    rows, page, total = counted_page(df, order, max(page, 1), size, hold=True)
    return rows.select(
        "*",
        F.lit(page).alias("page"),
        F.lit(page_bounds(total, page, size)[1]).alias("total_pages"),
        F.lit(total).cast("bigint").alias("total_results"),
    )


def page_unclamped(
    df: DataFrame, order: list[Column], page: int = 1, size: int = DEFAULT_PAGE, largest: int = LARGEST_PAGE, clamp: bool = True
) -> DataFrame:
    """A size outside 1 and ``largest`` becomes the default; a page past the end is empty."""
    page, size = max(page, 1), page_size(size, largest, clamp, DEFAULT_PAGE)
    rows, page, total = counted_page(df, order, page, size, hold=False)
    pages = ceil(total / size)
    return rows.select(
        "*",
        F.lit(page).alias("page"),
        F.lit(pages).alias("total_pages"),
        F.lit(total).cast("bigint").alias("total_files"),
        F.lit(page < pages).alias("has_next"),
        F.lit(page > 1).alias("has_previous"),
    )


def page_diagnostics(
    df: DataFrame, order: list[Column], page: int = 1, size: int = DEFAULT_PAGE, largest: int = LARGEST_PAGE, clamp: bool = True
) -> DataFrame:
    """Size held to 1 and ``largest``, page at least 1, at least one page, no upper hold."""
    size = page_size(size, largest, clamp)
    rows, page, total = counted_page(df, order, max(page, 1), size, hold=False)
    return rows.select(
        "*",
        F.lit(page).alias("page"),
        F.lit(page_bounds(total, page, size)[1]).alias("total_pages"),
        F.lit(total).cast("bigint").alias("total_diagnostics"),
    )


def with_page_number(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Page every row falls on in the whole ordering."""
    numbered = with_row_number(df, order, "place")
    return numbered.withColumn("page", F.ceil(F.col("place") / size).cast("bigint"))


def sort_by_name(df: DataFrame, *columns: str, collation: str | None = None) -> DataFrame:
    """Order by name and tie-breakers; ``collation='UNICODE'`` gives language order."""
    first, *rest = columns
    lead = F.collate(F.col(first), collation) if collation else F.col(first)
    return df.orderBy(lead, *rest)
