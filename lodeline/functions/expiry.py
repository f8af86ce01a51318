"""Remaining life of stored entries, from milliseconds left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3600000
DAY_MS = 24 * HOUR_MS
MINUTE_MS = 60000


def ttl_class(ms_left: Column) -> Column:
    return (
        F.when(ms_left.isNull(), F.lit("none"))
        .when(ms_left < 6 * HOUR_MS, F.lit("red"))
        .when(ms_left < 48 * HOUR_MS, F.lit("orange"))
        .otherwise(F.lit("green"))
    )


def format_ttl(ms_left: Column) -> Column:
    days = F.floor(ms_left / DAY_MS)
    hours = F.floor((ms_left % DAY_MS) / HOUR_MS)
    minutes = F.floor((ms_left % HOUR_MS) / MINUTE_MS)
    text = lambda value, unit: F.concat(value.cast("string"), F.lit(unit))
    return (
        F.when(ms_left.isNull(), F.lit("No expiry"))
        .when(ms_left <= 0, F.lit("Expired"))
        .when(days > 0, F.concat_ws(" ", text(days, "d"), text(hours, "h")))
        .when(hours > 0, F.concat_ws(" ", text(hours, "h"), text(minutes, "m")))
        .otherwise(text(minutes, "m"))
    )


def expires_soon(ms_left: Column) -> Column:
    return (ms_left >= 0) & (ms_left < 6 * HOUR_MS)
