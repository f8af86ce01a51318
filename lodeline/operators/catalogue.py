"""Package catalogue: versions, frameworks, types, overloads, docs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.naming import member_id_parts
from lodeline.functions.scoring import tier_score
from lodeline.session import cut_lineage

# Frameworks in the order they are tried.
FRAMEWORKS = [
    "net10.0", "net9.0", "net8.0", "net6.0", "netstandard2.1", "netstandard2.0", "netstandard1.6",
]
DEFAULT_FRAMEWORK = "net10.0"
# Kinds of types, in display order.
TYPE_KINDS = ["Class", "Interface", "Enum", "Struct", "Delegate"]
# Methods every type has, left out of listings.
OBJECT_METHODS = ["GetHashCode", "ToString", "Equals", "GetType", "Finalize", "MemberwiseClone"]
# Properties that are never shown.
SUPPRESSED_PROPERTIES = ["Patch"]


# Versions and frameworks ----------------------------------------------------


def stable_versions(versions: DataFrame, include_prerelease: bool = False) -> DataFrame:
    return versions if include_prerelease else versions.where(~F.contains("version", F.lit("-")))


def _tag_rank(tag: Column) -> Column:
    """Prerelease parts: numbers before words, numbers by value."""
    return F.transform(
        F.split(tag, r"\."),
        lambda p: F.struct(
            F.when(F.rlike(p, F.lit("^[0-9]+$")), 0).otherwise(1).alias("is_word"),
            F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("number"),
            F.lower(p).alias("word"),
        ),
    )


def version_rank(version: Column) -> Column:
    """Sortable form of a version: numeric parts, release above prerelease, then its parts."""
    core = F.split(F.regexp_extract(version, r"^([0-9.]*)", 1), r"\.")
    number = lambda i: F.coalesce(F.get(core, F.lit(i)).try_cast("bigint"), F.lit(0))
    tag = F.regexp_extract(version, r"^[^-+]*-([^+]*)", 1)
    return F.struct(
        *[number(i).alias(f"n{i}") for i in range(4)],
        (tag == "").alias("is_release"),
        _tag_rank(tag).alias("tag"),
    )


def latest_version(versions: DataFrame, include_prerelease: bool = False) -> DataFrame:
    return (
        stable_versions(versions, include_prerelease)
        .groupBy("package")
        .agg(F.max_by("version", version_rank(F.col("version"))).alias("version"))
    )


def framework_rank(framework: Column, requested: Column) -> Column:
    """Place in the order of preference; null when it is not on the list."""
    listed = F.array_position(F.array(*[F.lit(f) for f in FRAMEWORKS]), framework)
    return F.when(framework == requested, F.lit(0)).when(listed > 0, listed)


def pick_framework(assemblies: DataFrame, requested: str | None = None) -> DataFrame:
    """Rows of each package's best framework, or all its rows when none is on the list."""
    ranked = assemblies.withColumn("_rank", framework_rank(F.col("framework"), F.lit(requested)))
    best = ranked.groupBy("package").agg(F.min("_rank").alias("_best"))
    return (
        ranked.join(best, "package")
        .where(F.col("_best").isNull() | (F.col("_rank") == F.col("_best")))
        .drop("_rank", "_best")
    )


def publish_with_alias(rows: DataFrame, pinned: bool, include_prerelease: bool = False) -> DataFrame:
    """Rows under their own version and, unless it was pinned, also under ``latest``.

    Whether prereleases were admitted is part of the key, so the two lookups do
    not answer for each other.
    """
    framework = F.coalesce(F.nullif("framework", F.lit("")), F.lit(DEFAULT_FRAMEWORK))
    keyed = rows.withColumn("framework", framework).withColumn(
        "includes_prerelease", F.lit(include_prerelease)
    )
    if pinned:
        return keyed
    # one pass: each row is stored once or twice
    return keyed.withColumn("version", F.explode(F.array(F.col("version"), F.lit("latest"))))


def direct_dependencies(
    dependencies: DataFrame, targets: DataFrame
) -> DataFrame:
    """Dependencies of the group that fits the target best, at their minimum version.

    ``dependencies`` has (package, framework, dependency, min_version), targets
    have (package, framework). A group fits when it is not newer than the
    target in the order of preference; a group without framework fits anything.
    """
    table = F.array(*[F.lit(f) for f in FRAMEWORKS])
    place = lambda c: F.when(c == "", F.lit(len(FRAMEWORKS) + 1)).otherwise(
        F.nullif(F.array_position(table, c).cast("int"), F.lit(0))
    )
    groups = dependencies.select("package", "framework").distinct()
    wanted = targets.select("package", F.col("framework").alias("target"))
    best = (
        groups.join(wanted, "package")
        .withColumn("_place", place(F.col("framework")))
        .where(F.col("_place") >= place(F.col("target")))
        .groupBy("package")
        .agg(F.min_by("framework", "_place").alias("framework"))
    )
    return dependencies.join(best, ["package", "framework"]).select(
        "package", "framework", "dependency", F.col("min_version").alias("version")
    )


# Types and members ----------------------------------------------------------


def reflect_members(methods: DataFrame) -> DataFrame:
    """Public methods without those of every object and without special names.

    A nested type is named after the type that holds it.
    """
    nested = F.col("declaring_type").isNotNull() & (F.col("declaring_type") != "")
    return methods.where(
        F.col("is_public")
        & ~F.col("is_special")
        & (F.col("namespace") != "")
        & ~F.col("method").isin(OBJECT_METHODS)
    ).withColumn(
        "type_name",
        F.when(nested, F.concat_ws(".", "declaring_type", "type_name")).otherwise(F.col("type_name")),
    )


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in TYPE_KINDS]), kind) - 1


def usable_types(types: DataFrame) -> DataFrame:
    """Enums, structs, and types with any method, property or constructor."""
    return types.where(
        F.col("kind").isin("Enum", "Struct")
        | (F.col("n_methods") > 0)
        | (F.col("n_props") > 0)
        | (F.col("n_ctors") > 0)
    )


def types_by_kind(types: DataFrame, *keys: str) -> DataFrame:
    return (
        usable_types(types)
        .groupBy(*keys, "kind")
        .agg(F.count("*").alias("types"))
        .withColumn("kind_rank", kind_rank(F.col("kind")))
    )


def type_hint(
    kind: Column, n_ctors: Column, n_methods: Column, n_props: Column, n_fields: Column, n_static: Column
) -> Column:
    """``[2 ctors, 14 methods, 3 props]``, or the number of values or options."""

    def part(count: Column, word: str) -> Column:
        plural = F.when(count > 1, F.lit("s")).otherwise(F.lit(""))
        return F.when(count > 0, F.concat(count.cast("string"), F.lit(f" {word}"), plural))

    text = F.concat_ws(", ", part(n_ctors, "ctor"), part(n_methods, "method"), part(n_props, "prop"))
    boxed = lambda inner: F.concat(F.lit(" ["), inner, F.lit("]"))
    return (
        F.when(kind == "Enum", boxed(F.concat(n_fields.cast("string"), F.lit(" values"))))
        .when(kind == "Struct", F.when(
            n_static > 0, boxed(F.concat(n_static.cast("string"), F.lit(" options")))
        ).otherwise(F.lit("")))
        .otherwise(F.when(text != "", boxed(text)).otherwise(F.lit("")))
    )


def readable_props(props: DataFrame, surface: bool = False) -> DataFrame:
    """Readable properties that may be shown; the surface view also drops static ones."""
    hidden = F.lower("name").isin([p.lower() for p in SUPPRESSED_PROPERTIES])
    shown = props.where(F.col("can_read") & ~hidden)
    return shown.where(~F.col("is_static")) if surface else shown


def overload_note(others: Column) -> Column:
    return (
        F.when(others == 0, F.lit(""))
        .when(others == 1, F.lit("// + 1 overload"))
        .otherwise(F.concat(F.lit("// + "), others.cast("string"), F.lit(" overloads")))
    )


def collapse_overloads(methods: DataFrame, *type_keys: str) -> DataFrame:
    """Per method name: the overload with fewest parameters, and how many others there are."""
    return (
        methods.groupBy(*type_keys, "method")
        .agg(
            F.min_by("signature", F.struct("n_params", "is_generic", "pos")).alias("signature"),
            (F.count("*") - 1).alias("others"),
        )
        .withColumn("note", overload_note(F.col("others")))
    )


def expand_overloads(methods: DataFrame, type_name: str, method: str) -> DataFrame:
    """All overloads of one method, fewest parameters first."""
    return methods.where((F.col("type_name") == type_name) & (F.col("method") == method)).orderBy(
        "n_params", "pos"
    )


def collapse_ctors(ctors: DataFrame, *type_keys: str) -> DataFrame:
    """Per parameter count: the first constructor and how many others there are."""
    return (
        ctors.groupBy(*type_keys, "n_params")
        .agg(F.min_by("signature", "pos").alias("signature"), (F.count("*") - 1).alias("others"))
        .withColumn("note", overload_note(F.col("others")))
    )


def method_keys(methods: DataFrame, *file_keys: str) -> DataFrame:
    """Storage key of each method: plain name when unique in its file, else with its class."""
    counts = methods.groupBy(*file_keys, "method_name").agg(F.count("*").alias("same_name"))
    return methods.join(counts, [*file_keys, "method_name"]).withColumn(
        "method_key",
        F.when(F.col("same_name") > 1, F.concat_ws("::", "class_name", "method_name")).otherwise(
            F.col("method_name")
        ),
    )


def namespace_union(types: DataFrame, *package_keys: str) -> DataFrame:
    """Namespaces over all assemblies of a package with their first place and type count."""
    return types.groupBy(*package_keys, "namespace").agg(
        F.min("pos").alias("first_pos"), F.count("*").alias("types")
    )


def ancestors(types: DataFrame) -> DataFrame:
    """``type_name, at, depth``: every type with itself and all its known bases.

    A base of an unknown name ends the walk. Each round doubles the reach, so
    there are as many as the logarithm of the deepest chain; a type comes back
    once, at its least depth, so a circle of bases ends too.
    """
    known = types.select("type_name").distinct()
    step = types.where("base is not null").select("type_name", F.col("base").alias("at")).distinct()
    step = cut_lineage(step.join(known.withColumnRenamed("type_name", "at"), "at", "left_semi").select("type_name", "at"))
    reach, length, size = known.select("type_name", F.col("type_name").alias("at"), F.lit(0).alias("depth")), 1, -1
    while not step.isEmpty():
        next_ = step.select(F.col("type_name").alias("at"), F.col("at").alias("_next"))
        further = reach.join(next_, "at").select("type_name", F.col("_next").alias("at"), (F.col("depth") + length).alias("depth"))
        reach = cut_lineage(reach.unionByName(further).groupBy("type_name", "at").agg(F.min("depth").alias("depth")))
        grown = reach.count()
        if grown == size:
            break
        size = grown
        step = cut_lineage(step.join(next_, "at").select("type_name", F.col("_next").alias("at")))
        length *= 2
    return reach


def inherited_properties(types: DataFrame, props: DataFrame) -> DataFrame:
    """Properties of every type with those of its bases; the most derived one wins.

    ``types`` has (type_name, base), ``props`` (type_name, name, value_type).
    """
    declared = props.withColumnRenamed("type_name", "at")
    return (
        ancestors(types).join(declared, "at")
        .groupBy("type_name", "name")
        .agg(
            F.min_by(F.struct("value_type", F.col("at")), "depth").alias("p"),
            F.min("depth").alias("depth"),
        )
        .select("type_name", "name", "p.value_type", F.col("p.at").alias("declared_in"), "depth")
    )


# Docs -----------------------------------------------------------------------


def first_wins_merge(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First entry per key, ignoring the case of the keys."""
    rest = [c for c in entries.columns if c not in order]
    folded = [F.lower(k).alias(f"_{k}") for k in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in entries.columns]), F.struct(*order))
    return entries.groupBy(*folded).agg(first.alias("e")).select(*[f"e.{c}" for c in rest + order])


def resolve_docs(docs: DataFrame, identifier: str, type_hint: str | None = None) -> DataFrame:
    """Entries whose short name is the identifier; a dotted one or a hint also names the type."""
    identifier = identifier.strip()
    cut = identifier.rfind(".")
    owner, member = (identifier[:cut], identifier[cut + 1 :]) if cut > 0 else (None, identifier)
    if type_hint and type_hint.strip():
        owner = type_hint
    parts = member_id_parts(F.col("member_id"))
    found = docs.where(F.lower(parts["short_name"]) == member.lower())
    return found if owner is None else found.where(F.lower(parts["type_segment"]) == owner.lower())


def docs_for_member(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Docs of (package, version) requests: the version asked for, else ``latest``.

    The choice is made per package, on the distinct versions that have docs.
    """
    has = docs.select("package", F.col("version").alias("found_version")).distinct()
    tries = requests.select("package", "version").distinct().select(
        "package",
        "version",
        F.posexplode(F.array(F.coalesce("version", F.lit("latest")), F.lit("latest"))).alias(
            "place", "found_version"
        ),
    )
    chosen = (
        tries.join(has, ["package", "found_version"], "left_semi")
        .groupBy("package", "version")
        .agg(F.min_by("found_version", "place").alias("found_version"))
    )
    return chosen.join(docs.withColumnRenamed("version", "found_version"), ["package", "found_version"])


# Search ---------------------------------------------------------------------


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(F.translate(tags, ",", " "), " "), lambda t: F.trim(t)), lambda t: t != "")


def search_catalogue(packages: DataFrame, query: str, take: int = 20, most: int = 100) -> DataFrame:
    """Best ``take`` packages for a keyword; ``most`` bounds what may be asked for."""
    if not query.strip():
        raise ValueError("query is empty")
    if not 1 <= take <= most:
        raise ValueError(f"take must be between 1 and {most}")
    return (
        packages.withColumn("score", tier_score(F.col("package"), query))
        .where("score > 0")
        .orderBy(F.desc("score"), "package", "version")
        .limit(take)
    )


def entries_by_key(entries: DataFrame) -> DataFrame:
    return entries.orderBy("package", "version", "framework")
