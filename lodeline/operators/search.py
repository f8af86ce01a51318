"""Ranked search over the member index and method bodies.

The index is one long table (project, path, parent, member_type, name, line),
so every kind of member is scored in the same scan, and ``*`` needs no union of
projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.scoring import attribute_name, attribute_score, name_score
from lodeline.functions.text import contains_fold
from lodeline.operators.ordered import page_clamped
from lodeline.operators.policy import project_filter

# Kinds of members, in display order.
MEMBER_TYPES = [
    "All", "Class", "Interface", "Method", "Property", "Field", "Enum", "Struct", "Attribute",
]
BODY_SCORE = 0.8
HIT_COLUMNS = ["project", "path", "parent", "member_type", "name", "line"]


def is_content_query(query: str) -> bool:
    """Whether a query reads like text, so that method bodies are searched too."""
    return " " in query or ":" in query or '"' in query or len(query) > 15


def member_type_filter(members: DataFrame, member_type: str = "All") -> DataFrame:
    if member_type not in MEMBER_TYPES:
        raise ValueError(f"member_type must be one of {MEMBER_TYPES}")
    return members if member_type == "All" else members.where(F.col("member_type") == member_type)


def member_rank(member_type: Column) -> Column:
    table = F.array(*[F.lit(t) for t in MEMBER_TYPES])
    return F.array_position(table, member_type) - 1


def scored_members(
    members: DataFrame, query: str, case_sensitive: bool = False, scorer: str = "simple"
) -> DataFrame:
    """Every member with its score; attributes are scored and shown without their suffix."""
    name, is_attribute = F.col("name"), F.col("member_type") == "Attribute"
    return members.withColumn(
        "score",
        F.when(is_attribute, attribute_score(name, query, case_sensitive, scorer)).otherwise(
            name_score(name, query, case_sensitive, scorer)
        ),
    ).withColumn("name", F.when(is_attribute, attribute_name(name, scorer)).otherwise(name))


def member_hits(
    members: DataFrame,
    query: str,
    member_type: str = "All",
    case_sensitive: bool = False,
    scorer: str = "simple",
) -> DataFrame:
    kept = member_type_filter(members, member_type)
    return scored_members(kept, query, case_sensitive, scorer).where("score > 0")


def body_hits(bodies: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Methods whose code contains the query, at the line of the first hit."""
    code = F.col("full_code") if case_sensitive else F.lower("full_code")
    text = query if case_sensitive else query.lower()
    before = F.substring_index(code, text, 1)
    offset = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    line = F.col("line") if "\n" in query else F.col("line") + offset
    return bodies.where(F.contains(code, F.lit(text))).select(
        "project",
        "path",
        F.col("class_name").alias("parent"),
        F.lit("Method").alias("member_type"),
        F.col("method_name").alias("name"),
        line.cast("bigint").alias("line"),
        F.lit(BODY_SCORE).alias("score"),
    )


def rank_order() -> list[Column]:
    return [F.desc("score"), F.asc("name")] + [
        F.asc(c) for c in ("project", "path", "line", "parent", "member_type")
    ]


def rank(hits: DataFrame) -> DataFrame:
    return hits.orderBy(*rank_order())


def all_hits(
    members: DataFrame,
    bodies: DataFrame | None,
    query: str,
    project: str = "*",
    member_type: str = "All",
    case_sensitive: bool = False,
    scorer: str = "simple",
) -> DataFrame:
    """Name hits, and body hits for content queries. A method may appear in both."""
    hits = member_hits(
        project_filter(members, project), query, member_type, case_sensitive, scorer
    ).select(*HIT_COLUMNS, "score")
    if bodies is None or not is_content_query(query) or member_type not in ("All", "Method"):
        return hits
    return hits.unionByName(body_hits(project_filter(bodies, project), query, case_sensitive))


def search(
    members: DataFrame,
    bodies: DataFrame | None,
    query: str,
    project: str = "*",
    member_type: str = "All",
    case_sensitive: bool = False,
    scorer: str = "simple",
    page: int = 1,
    size: int = 20,
) -> DataFrame:
    """One ranked page of hits."""
    hits = all_hits(members, bodies, query, project, member_type, case_sensitive, scorer)
    return page_clamped(hits, rank_order(), max(page, 1), size)


def search_summary(
    members: DataFrame,
    bodies: DataFrame | None,
    query: str,
    project: str = "*",
    member_type: str = "All",
    case_sensitive: bool = False,
    scorer: str = "simple",
    page: int = 1,
    size: int = 20,
) -> DataFrame:
    """Totals of a search: hits, files, projects, pages. One pass, one row."""
    kept = project_filter(members, project)
    wanted = F.lit(True) if member_type == "All" else F.col("member_type") == member_type
    rows = scored_members(kept, query, case_sensitive, scorer).select(
        "project", "path", (wanted & (F.col("score") > 0)).cast("int").alias("hit")
    )
    if bodies is not None and is_content_query(query) and member_type in ("All", "Method"):
        found = body_hits(project_filter(bodies, project), query, case_sensitive)
        rows = rows.unionByName(found.select("project", "path", F.lit(1).alias("hit")))
    per_file = rows.groupBy("project", "path").agg(F.sum("hit").alias("hits"))
    totals = per_file.groupBy("project").agg(F.sum("hits").alias("hits"), F.count("*").alias("files"))
    pages = F.greatest(F.ceil(F.col("total_results") / size), F.lit(1)).cast("bigint")
    shown = F.least(F.lit(max(page, 1)).cast("bigint"), F.col("total_pages"))
    return (
        totals.agg(
            F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("total_results"),
            F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files_scanned"),
            F.count("*").alias("projects_searched"),
        )
        .withColumn("total_pages", pages)
        .withColumn("page", shown)
        .withColumn("has_next", F.col("page") < F.col("total_pages"))
    )


def hits_by_project_type(hits: DataFrame) -> DataFrame:
    """Hits per project and member type, with the total of the project."""
    per_type = hits.groupBy("project", "member_type").agg(F.count("*").alias("hits"))
    per_project = per_type.groupBy("project").agg(F.sum("hits").alias("project_hits"))
    return per_type.join(per_project, "project").withColumn(
        "type_rank", member_rank(F.col("member_type"))
    )


def name_hits(table: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows where some of the columns contains the query, ignoring case."""
    text = query.strip().lower()
    if not text:
        return table
    hit = F.lit(False)
    for column in columns:
        hit = hit | contains_fold(F.col(column), text)
    return table.where(hit)


def lookup_many(methods: DataFrame, requests: DataFrame) -> DataFrame:
    """All overloads of the requested methods.

    A request without a class is marked ambiguous when the file has several
    methods of that name. Requests have (path, name, class_name or null).
    """
    wanted = requests.select(
        "path",
        F.col("name").alias("method_name"),
        F.coalesce("class_name", F.lit("")).alias("wanted_class"),
    ).distinct()
    keys = ["path", "method_name", "wanted_class"]
    found = methods.join(wanted, ["path", "method_name"]).where(
        (F.col("wanted_class") == "") | (F.col("wanted_class") == F.col("class_name"))
    )
    matches = found.groupBy(*keys).agg(F.count("*").alias("matches"))
    return found.join(matches, keys).withColumn(
        "ambiguous", (F.col("wanted_class") == "") & (F.col("matches") > 1)
    )


def not_found(methods: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested methods that the file does not define."""
    named = methods.select("path", F.col("method_name").alias("name")).distinct()
    return requests.join(named, ["path", "name"], "left_anti")


def available_names(methods: DataFrame, *scope: str, name: str = "method_name") -> DataFrame:
    """Distinct names on offer in each scope, one row each."""
    return methods.select(*scope, F.col(name).alias("available")).distinct()
