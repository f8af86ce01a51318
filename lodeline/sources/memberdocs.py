"""Member documentation files in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.naming import markup_to_text
from lodeline.functions.policy import norm_path

TEXT_PARTS = ["summary", "returns", "remarks", "example"]


def _child(tag: str) -> Column:
    found = F.regexp_extract("_member", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return markup_to_text(found)


def _named(tag: str, attribute: str) -> Column:
    """Map from the attribute of each ``tag`` element to its text."""
    shape = rf'(?s)<{tag}\s[^>]*?{attribute}="([^"]*)"[^>]*?(?:/>|>(.*?)</{tag}>)'
    each = F.regexp_extract_all(F.col("_member"), F.lit(shape), F.lit(0))
    pairs = F.transform(
        each,
        lambda e: F.struct(
            F.regexp_extract(e, shape, 1),
            F.coalesce(markup_to_text(F.regexp_extract(e, shape, 2)), F.lit("")),
        ),
    )
    # the last element of a name counts
    names = F.transform(pairs, lambda p: p["col1"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["col1"]))
    return F.map_from_entries(last)


def scan_member_docs(files: DataFrame) -> DataFrame:
    """Members documented in the files under a ``lib`` folder, less those without content."""
    under_lib = F.rlike(norm_path(F.col("path")), F.lit("(?i)(^|/)lib/"))
    members = F.regexp_extract_all(F.col("content"), F.lit(r"(?s)<member\s[^>]*[^/]>.*?</member>"), F.lit(0))
    return (
        files.where(under_lib)
        .select("package", "version", "path", F.posexplode(members).alias("pos", "_member"))
        .select(
            "package",
            "version",
            "path",
            "pos",
            F.regexp_extract("_member", r'^<member\s[^>]*?name="([^"]*)"', 1).alias("member_id"),
            *[_child(tag).alias(tag) for tag in TEXT_PARTS],
            _named("param", "name").alias("params"),
            _named("typeparam", "name").alias("type_params"),
            _named("exception", "cref").alias("exceptions"),
        )
        .where(
            "trim(member_id) <> '' and (coalesce(summary, returns, remarks, example) is not null"
            " or size(params) > 0 or size(type_params) > 0 or size(exceptions) > 0)"
        )
    )
