"""Shape and statistics of response bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response headers that may be shown.
SAFE_HEADERS = [
    "content-type", "content-length", "x-request-id",
    "x-correlation-id", "x-trace-id", "date",
    "cache-control", "etag", "last-modified",
    "x-powered-by", "server",
]


def allowlist_map(headers: Column, names: list[str] = SAFE_HEADERS) -> Column:
    allowed = [n.lower() for n in names]
    return F.map_filter(headers, lambda key, _: F.lower(key).isin(allowed))


def is_json_type(content_type: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("json"))


def is_text_type(content_type: Column) -> Column:
    return F.rlike(F.lower(content_type), F.lit("json|text|xml"))


def json_kind(body: Column) -> Column:
    """``array``, ``object``, ``scalar``, or null when the body is not JSON."""
    schema = F.schema_of_variant(F.try_parse_json(body))
    return (
        F.when(schema.isNull(), F.lit(None).cast("string"))
        .when(F.startswith(schema, F.lit("ARRAY")), F.lit("array"))
        .when(F.startswith(schema, F.lit("OBJECT")), F.lit("object"))
        .otherwise(F.lit("scalar"))
    )


def payload_shape(content_type: Column, body: Column) -> Column:
    kind = json_kind(body)
    return (
        F.when(body.isNull() | (body == ""), F.lit("empty"))
        .when(~is_text_type(content_type), F.lit("binary"))
        .when(is_json_type(content_type) & kind.isin("array", "object"), kind)
        .otherwise(F.lit("text"))
    )


def payload_stats(content_type: Column, body: Column, limit: int, top_k: int) -> dict[str, Column]:
    """Counts that go with the shape; a count that does not apply is -1."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")
    shape = payload_shape(content_type, body)
    over = F.octet_length(body) > limit
    items = F.json_array_length(body)
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return {
        "shape": shape,
        "array_count": F.when(shape == "array", items).otherwise(F.lit(-1)),
        "top_level_keys": F.when(
            shape == "object", F.array_join(F.json_object_keys(body), ",")
        ).otherwise(F.lit("")),
        "line_count": F.when(shape == "text", lines).otherwise(F.lit(-1)),
        "shown": F.when(shape == "array", F.least(items, F.lit(top_k)))
        .when((shape == "text") & ~is_json_type(content_type), F.least(lines, F.lit(top_k)))
        .otherwise(F.lit(-1)),
        "truncated": F.when(shape == "empty", F.lit(False))
        .when(shape == "binary", F.lit(True))
        .when(shape == "array", over | (items > top_k))
        .otherwise(over),
    }


def preview_lines(body: Column, top_k: int) -> Column:
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")
    return F.substring_index(body, "\n", top_k)


def preview_items(body: Column, top_k: int) -> Column:
    """First ``top_k`` items of a JSON array, each as JSON text."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")
    items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    return F.transform(F.slice(items, 1, top_k), lambda item: F.to_json(item))
