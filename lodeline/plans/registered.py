"""Where queries and their SQL meet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeline.session import settle, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

# Lengths and ranges are BIGINT in SQL where the model has int, and the other way
# round for some literals: columns to cast in the SQL, by query.
WIDTHS: dict[str, dict[str, str]] = {
    "deepest_first": {"depth": "INTEGER"},
    "evict_paths": {"lines": "INTEGER"},
    "explode_lines": {"line_no": "INTEGER"},
    "file_index": {"types": "BIGINT", "methods": "BIGINT"},
    "folders_to_delete": {"depth": "INTEGER"},
    "full_pass": {"lines": "INTEGER"},
    "grep_counts": {"match_count": "INTEGER", "total_lines": "INTEGER"},
    "grep_documents": {"line_no": "INTEGER"},
    "grep_ranked_page": {"match_count": "INTEGER", "total_lines": "INTEGER"},
    "hits_by_project_type": {"type_rank": "BIGINT"},
    "line_counts": {"split_lines": "INTEGER", "read_lines": "INTEGER"},
    "line_range": {"total_lines": "INTEGER", "end_line": "INTEGER", "line_no": "INTEGER"},
    "number_lines": {"line_no": "INTEGER"},
    "page_tags": {"tag_no": "INTEGER"},
    "parse_package_logs": {"line_no": "INTEGER"},
    "payload_stats": {"array_count": "INTEGER", "line_count": "INTEGER", "shown": "INTEGER"},
    "purge_project": {"lines": "INTEGER"},
    "read_index": {"lines": "INTEGER"},
    "read_through": {"lines": "INTEGER"},
    "tag_attributes": {"tag_no": "INTEGER"},
    "types_by_kind": {"kind_rank": "BIGINT"},
    "write_index": {"lines": "INTEGER"},
}

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: function(settle(spark), sf_dir)
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in WIDTHS.get(name, {}).items())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q" if casts else sql
        return function

    return add


def fresh_dir(spark: SparkSession, label: str) -> str:
    """An unused folder below the shared one, for queries that write."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
