"""Call and dependency edges.

``calls`` has (path, caller_class, caller_method, line, callee_method,
callee_class); ``methods`` has (path, class_name, method_name, line). Any number
of targets is answered by one join over the stored edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.operators.depgraph import HUB_EDGES, along, split_edges
from lodeline.operators.ordered import page_clamped, with_row_number
from lodeline.session import stored

CALLER_ORDER = ["path", "line", "caller_class", "caller_method", "callee_class"]


def find_target(methods: DataFrame, targets: DataFrame) -> DataFrame:
    """First overload of each (path, method_name, class or null), or why there is none.

    ``status`` is ``ok``, ``not_found``, ``class_not_found`` or ``class_required``.
    """
    wanted = targets.select(
        "path", "method_name", F.coalesce("class_name", F.lit("")).alias("wanted_class")
    ).distinct()
    keys = ["path", "method_name"]
    per_class = methods.groupBy(*keys, "class_name").agg(F.min("line").alias("line"))
    classes = per_class.groupBy(*keys).agg(
        F.count("*").alias("classes"), F.min_by("class_name", F.struct("line", "class_name")).alias("only")
    )
    picked = wanted.join(classes, keys, "left").withColumn(
        "class_name", F.when(F.col("classes") == 1, F.col("only")).otherwise(F.col("wanted_class"))
    )
    return (
        picked.join(per_class, keys + ["class_name"], "left")
        .withColumn(
            "status",
            F.when(F.col("classes").isNull(), F.lit("not_found"))
            .when((F.col("classes") > 1) & (F.col("wanted_class") == ""), F.lit("class_required"))
            .when(F.col("line").isNull(), F.lit("class_not_found"))
            .otherwise(F.lit("ok")),
        )
        .select("path", "method_name", "wanted_class", "class_name", "line", "status")
    )


def callers(calls: DataFrame, targets: DataFrame, hot_calls: int = HUB_EDGES) -> DataFrame:
    """Call sites of each target by name alone; calls from the target's own file are left out.

    Targets have (target_path, target_method) and one row each. A name with more
    than ``hot_calls`` calls is found first; its calls are dealt to parts of about
    so many, and its targets are repeated for each part. There are at most as many
    such names as the calls divided by ``hot_calls``.
    """
    named = targets.select("target_path", "target_method").distinct()
    wanted = named.select(F.col("target_method").alias("callee_method")).distinct()
    counts = calls.join(wanted, "callee_method", "left_semi").groupBy("callee_method").agg(F.count("*").alias("_n"))
    parts = stored(counts.where(F.col("_n") > hot_calls).select("callee_method", F.ceil(F.col("_n") / hot_calls).cast("int").alias("_parts")))
    apart = F.col("path") != F.col("target_path")
    if parts.isEmpty():
        return calls.join(named, F.col("callee_method") == F.col("target_method")).where(apart)
    part = F.pmod(F.xxhash64("path", "line", "caller_class", "caller_method"), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = calls.join(parts, "callee_method", "left").withColumn("_part", part).select(*calls.columns, "_part")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    repeated = named.join(parts.withColumnRenamed("callee_method", "target_method"), "target_method", "left").select(*named.columns, every.alias("_to"))
    met = (F.col("callee_method") == F.col("target_method")) & (F.col("_part") == F.col("_to"))
    return dealt.join(repeated, met).where(apart).drop("_part", "_to")


def callees(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls made inside each target (path, class_name, method_name)."""
    inside = targets.select(
        "path", F.col("class_name").alias("caller_class"), F.col("method_name").alias("caller_method")
    ).distinct()
    return calls.join(inside, ["path", "caller_class", "caller_method"], "left_semi")


def class_count_per_file(types: DataFrame, class_column: str = "class_name") -> DataFrame:
    """Classes in each file and whether it is the only one."""
    distinct = types.select("path", class_column).distinct()
    return (
        distinct.groupBy("path")
        .agg(F.count("*").alias("classes_in_file"))
        .withColumn("is_single_class", F.col("classes_in_file") == 1)
    )


def with_class_count(calls: DataFrame, types: DataFrame, class_column: str = "class_name") -> DataFrame:
    return calls.join(class_count_per_file(types, class_column), "path", "left")


def caller_hint(class_name: Column, is_single_class: Column) -> Column:
    return F.when(is_single_class, F.lit("")).otherwise(
        F.concat(F.lit(" (className: `"), class_name, F.lit("`)"))
    )


def call_category(callee_class: Column) -> Column:
    return (
        F.when(callee_class == "SameClass", F.lit("same"))
        .when(F.contains(callee_class, F.lit("System")) | (callee_class == "Unknown"), F.lit("system"))
        .otherwise(F.lit("external"))
    )


def call_categories(calls: DataFrame, *keys: str) -> DataFrame:
    """Outgoing calls by kind of receiver."""
    return (
        calls.withColumn("category", call_category(F.col("callee_class")))
        .groupBy(*keys, "category")
        .agg(F.count("*").alias("calls"))
    )


def external_calls(calls: DataFrame) -> DataFrame:
    """All calls less the system calls and the calls of the own class."""
    return calls.where(call_category(F.col("callee_class")) == "external")


def graph_totals(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Inbound calls, outbound calls and distinct calling files per target.

    Targets have (path, class_name, method_name). Each side is aggregated
    before it is joined, so no pair of calls is ever formed.
    """
    named = targets.select("path", "class_name", "method_name").distinct()
    inbound = calls.groupBy(F.col("callee_method").alias("method_name"), "path").agg(
        F.count("*").alias("n")
    )
    every = inbound.groupBy("method_name").agg(F.sum("n").alias("all_calls"), F.count("*").alias("all_files"))
    own = inbound.select("method_name", "path", F.col("n").alias("own_calls"))
    outbound = calls.groupBy(
        "path", F.col("caller_class").alias("class_name"), F.col("caller_method").alias("method_name")
    ).agg(F.count("*").alias("outbound"))
    own_calls = F.coalesce("own_calls", F.lit(0))
    return (
        named.join(every, "method_name", "left")
        .join(own, ["method_name", "path"], "left")
        .join(outbound, ["path", "class_name", "method_name"], "left")
        .select(
            "path",
            "class_name",
            "method_name",
            (F.coalesce("all_calls", F.lit(0)) - own_calls).alias("inbound"),
            F.coalesce("outbound", F.lit(0)).alias("outbound"),
            (
                F.coalesce("all_files", F.lit(0)) - F.when(F.col("own_calls").isNull(), 0).otherwise(1)
            ).alias("files"),
        )
    )


def call_graph(
    calls: DataFrame, target_path: str, target_class: str, target_method: str, page: int = 1, size: int = 20
) -> DataFrame:
    """One page of callers and all callees of a target, one hop each way."""
    spark = calls.sparkSession
    target = spark.createDataFrame(
        [(target_path, target_class, target_method)], "target_path string, target_class string, target_method string"
    )
    inbound = page_clamped(callers(calls, target), [F.col(c) for c in CALLER_ORDER], page, size)
    outbound = callees(
        calls,
        target.select(
            F.col("target_path").alias("path"),
            F.col("target_class").alias("class_name"),
            F.col("target_method").alias("method_name"),
        ),
    )
    columns = lambda direction, cls, method: [
        F.lit(direction).alias("direction"),
        "path",
        F.col(cls).alias("class_name"),
        F.col(method).alias("method_name"),
        "line",
    ]
    return inbound.select(*columns("caller", "caller_class", "caller_method")).unionByName(
        outbound.select(*columns("callee", "callee_class", "callee_method"))
    )


def dependency_edges(ctor_params: DataFrame) -> DataFrame:
    """Distinct edges from a class to the types its constructor takes."""
    return ctor_params.select(
        "project", F.col("type_name").alias("from_type"), F.col("type").alias("to_type")
    ).distinct()


def call_levels(calls: DataFrame, targets: DataFrame, depth: int, direction: str = "callers") -> DataFrame:
    """Methods up to ``depth`` calls away from each target, with the least number of calls.

    Targets have (target) and calls (caller, callee), both names of methods. The
    levels of all targets are found side by side; a table of what each target has
    seen ends circles, so a method comes once, at its nearest level. A target that
    is met again comes with the level at which it is. Rows that a level sends are
    one per target and method; a method with very many calls is split.
    """
    if depth < 1:
        raise ValueError("the depth is at least 1")
    at, to = ("dst", "src") if direction == "callers" else ("src", "dst")
    edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).dropna().distinct()
    edges = stored(edges)  # every level reads them
    dealt = split_edges(edges, at)
    frontier = targets.select("target").dropna().distinct().withColumn("id", F.col("target"))
    seen = None
    for level in range(1, depth + 1):
        reached = along(frontier, *dealt, at).select("target", F.col(to).alias("id")).distinct()
        if seen is not None:
            reached = reached.join(seen.select("target", "id"), ["target", "id"], "left_anti")
        frontier = stored(reached)
        found = frontier.withColumn("level", F.lit(level))
        seen = found if seen is None else seen.unionByName(found)
        if level < depth and frontier.isEmpty():
            break
    return seen.select("target", F.col("id").alias("method"), "level")


def level_pages(levels: DataFrame, size: int = 20) -> DataFrame:
    """Page of each method inside the level of its target, in the order of names."""
    keyed = levels.groupBy("target", "level").agg(F.count("*").alias("_n"))
    keys = [F.col("target"), F.col("level"), F.col("method")]
    numbered = with_row_number(levels, keys, "_row")
    first = numbered.groupBy("target", "level").agg(F.min("_row").alias("_first"))
    placed = numbered.join(first.join(keyed, ["target", "level"]), ["target", "level"])
    return placed.select(
        "target", "level", "method", (F.floor((F.col("_row") - F.col("_first")) / size) + 1).alias("page"),
        F.ceil(F.col("_n") / size).alias("total_pages"),
    )
