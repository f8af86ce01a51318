"""Sizes, line counts, markers, cutoffs and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGE_BYTES = 15 * 1024

# noncharacters, which Unicode keeps free for internal use: around a match, between its groups
MATCH, GROUP = "\ufdd3", "\ufdd4"

# Markers looked for in a source file, and the labels they give.
TYPE_MARKERS = ["class ", "interface ", "record "]
TOP_LEVEL_MARKERS = ["var ", "await ", "using ", "builder."]
REGISTRATION_MARKERS = [
    "builder.Services.Add", "services.Add", "AddSingleton", "AddScoped", "AddTransient",
]
SERVER_MARKERS = ["AddMcpServer", "WithTools", "MapMcpServer", "McpServerTool"]
TOP_LEVEL_LABEL = "Top-level statements (modern .NET)"
REGISTRATION_LABEL = "Dependency injection registration"
SERVER_LABEL = "MCP server configuration"
SOURCE_LABELS = {"app.Use": "Middleware pipeline", "[Route": "API routes/controllers"}
CONFIG_LABELS = {
    '"ConnectionStrings"': "Database connection strings",
    '"Logging"': "Logging configuration",
}


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def contains_fold(text: Column, needle: str) -> Column:
    """Substring test that ignores case."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def captures(text: Column, pattern: str, groups: int) -> Column:
    """The groups of every match, as an array of arrays, from one pass over the text.

    The marks it works with become replacement characters where the text holds them.
    """
    text = F.translate(text, MATCH + GROUP, "\ufffd\ufffd")
    marks = MATCH + GROUP.join(f"${i}" for i in range(1, groups + 1)) + MATCH
    pieces = F.split(F.regexp_replace(text, pattern, marks), MATCH)
    found = F.filter(pieces, lambda _, i: i % 2 == 1)
    return F.transform(found, lambda piece: F.split(piece, GROUP))


def one_decimal(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")


def format_size(size: Column) -> Column:
    size = size.cast("double")
    return (
        F.when(size < 1024, F.concat(one_decimal(size), F.lit("B")))
        .when(size < 1024.0**2, F.concat(one_decimal(size / 1024.0), F.lit("KB")))
        .when(size < 1024.0**3, F.concat(one_decimal(size / 1024.0**2), F.lit("MB")))
        .otherwise(F.concat(one_decimal(size / 1024.0**3), F.lit("GB")))
    )


def is_large(content: Column) -> Column:
    return F.octet_length(content) > LARGE_BYTES


def split_line_count(content: Column) -> Column:
    """Pieces between newlines: a final newline opens one more, empty line."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def read_line_count(content: Column) -> Column:
    """Lines as a line reader sees them: a final newline ends the last line."""
    return F.when(content == "", F.lit(0)).otherwise(
        split_line_count(content) - F.when(F.endswith(content, F.lit("\n")), 1).otherwise(0)
    )


def content_markers(content: Column, ext: Column) -> dict[str, Column]:
    """Flags and labels that describe a source or configuration file."""
    source, config = ext == ".cs", ext == ".json"
    has_types = source & contains_any(content, TYPE_MARKERS)
    top_level = source & ~contains_any(content, TYPE_MARKERS) & contains_any(content, TOP_LEVEL_MARKERS)
    registers = source & contains_any(content, REGISTRATION_MARKERS)
    serves = source & contains_any(content, SERVER_MARKERS)
    labels = [
        F.when(top_level, F.lit(TOP_LEVEL_LABEL)),
        F.when(registers, F.lit(REGISTRATION_LABEL)),
        F.when(serves, F.lit(SERVER_LABEL)),
    ]
    for word, label in SOURCE_LABELS.items():
        labels.append(F.when(source & F.contains(content, F.lit(word)), F.lit(label)))
    for word, label in CONFIG_LABELS.items():
        labels.append(F.when(config & F.contains(content, F.lit(word)), F.lit(label)))
    return {
        "has_types": has_types,
        "top_level": top_level,
        "registers_services": registers,
        "configures_server": serves,
        "is_configuration": config,
        "patterns": F.concat_ws("; ", *labels),
    }


def number_line(line_no: Column, line: Column) -> Column:
    return F.format_string("%4d | %s", line_no, line)


def truncate_body(body: Column, limit: int, least: int = 256, most: int = 32768) -> tuple[Column, Column]:
    """The whole characters that fit into ``limit`` bytes, and whether the body has more bytes.

    A character has up to four bytes, so one of the last four places is where one ends.
    """
    if not least <= limit <= most:
        raise ValueError(f"limit must be between {least} and {most}")
    over = F.octet_length(body) > limit
    raw = body.cast("binary")
    next_byte = lambda size: F.hex(F.substring(raw, size + 1, 1))
    size = F.lit(limit - 3)
    for back in (2, 1, 0):
        size = F.when(~next_byte(limit - back).between("80", "BF"), F.lit(limit - back)).otherwise(size)
    cut = F.decode(F.substring(raw, F.lit(1), size), "UTF-8")
    return F.when(over, cut).otherwise(body), over


def parse_cutoff(text: Column) -> Column:
    """Unix seconds or an ISO-8601 instant; null when neither."""
    return F.coalesce(
        F.timestamp_seconds(text.try_cast("bigint")),
        F.try_to_timestamp(text),
    )


def cutoff_value(text: str) -> Column:
    """A cutoff argument as a timestamp that fails when it cannot be read."""
    parsed = parse_cutoff(F.lit(text))
    return F.when(
        parsed.isNull(), F.raise_error(F.lit(f"cannot read cutoff: {text}")).cast("timestamp")
    ).otherwise(parsed)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    since = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1000000).cast("bigint")


def to_zone(ts: Column, zone: str) -> dict[str, Column]:
    """A UTC wall clock shown in UTC and in ``zone``, with its unix seconds."""
    pattern = "yyyy-MM-dd HH:mm:ss"
    utc = ts.cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return {
        "utc_time": F.date_format(utc, pattern),
        "zone_time": F.date_format(local, pattern),
        "unix_seconds": F.floor(epoch_micros(ts) / 1000000).cast("bigint"),
    }
