"""Queries over packages, types, overloads and docs."""

from pyspark.sql import functions as F

from lodeline.functions import naming as N
from lodeline.operators import catalogue as C
from lodeline.plans import views as V
from lodeline.plans.registered import query
from lodeline.plans.search_queries import tier_sql
from lodeline.sources import manifests as M
from lodeline.sources import memberdocs as D


# Types made from the parts ----------------------------------------------------

TYPES = f"""types_v AS (
  SELECT p_brand AS package, p_type AS namespace, {V.PART_NAME} || p_partkey AS type_name, p_partkey AS pos,
    CASE p_size % 5 WHEN 0 THEN 'Class' WHEN 1 THEN 'Interface' WHEN 2 THEN 'Enum' WHEN 3 THEN 'Struct' ELSE 'Delegate' END AS kind,
    p_partkey % 3 AS n_ctors, p_partkey % 4 AS n_methods, p_partkey % 2 AS n_props, p_size AS n_fields,
    p_partkey % 5 AS n_static
  FROM part)"""


def types(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size") % 5
    return V.table(spark, d, "part").select(
        F.col("p_brand").alias("package"),
        F.col("p_type").alias("namespace"),
        F.concat(V.part_name(), key.cast("string")).alias("type_name"),
        key.alias("pos"),
        F.when(size == 0, "Class").when(size == 1, "Interface").when(size == 2, "Enum")
        .when(size == 3, "Struct").otherwise("Delegate").alias("kind"),
        (key % 3).alias("n_ctors"),
        (key % 4).alias("n_methods"),
        (key % 2).alias("n_props"),
        F.col("p_size").alias("n_fields"),
        (key % 5).alias("n_static"),
    )


USABLE = "(kind IN ('Enum', 'Struct') OR n_ctors > 0 OR n_methods > 0 OR n_props > 0)"


@query("usable_types", f"WITH {TYPES} SELECT package, namespace, type_name, kind FROM types_v WHERE {USABLE}")
def usable_types(spark, d):
    return C.usable_types(types(spark, d)).select("package", "namespace", "type_name", "kind")


@query(
    "types_by_kind",
    f"""WITH {TYPES} SELECT package, kind, count(*) AS types,
      list_position(['Class', 'Interface', 'Enum', 'Struct', 'Delegate'], kind) - 1 AS kind_rank
    FROM types_v WHERE {USABLE} GROUP BY package, kind""",
)
def types_by_kind(spark, d):
    return C.types_by_kind(types(spark, d), "package")


def part_sql(count: str, word: str) -> str:
    return f"CASE WHEN {count} > 0 THEN {count} || ' {word}' || CASE WHEN {count} > 1 THEN 's' ELSE '' END END"


@query(
    "type_hints",
    f"""WITH {TYPES}, h AS (SELECT type_name, kind, n_fields, n_static, concat_ws(', ', {part_sql('n_ctors', 'ctor')},
        {part_sql('n_methods', 'method')}, {part_sql('n_props', 'prop')}) AS t FROM types_v)
    SELECT type_name, CASE WHEN kind = 'Enum' THEN ' [' || n_fields || ' values]'
      WHEN kind = 'Struct' THEN CASE WHEN n_static > 0 THEN ' [' || n_static || ' options]' ELSE '' END
      WHEN t = '' THEN '' ELSE ' [' || t || ']' END AS hint FROM h""",
)
def type_hints(spark, d):
    counts = [F.col(c) for c in ("kind", "n_ctors", "n_methods", "n_props", "n_fields", "n_static")]
    return types(spark, d).select("type_name", C.type_hint(*counts).alias("hint"))


@query(
    "namespace_union",
    f"WITH {TYPES} SELECT package, namespace, min(pos) AS first_pos, count(*) AS types FROM types_v GROUP BY package, namespace",
)
def namespace_union(spark, d):
    return C.namespace_union(types(spark, d), "package")


PROPS = """props_v AS (
  SELECT 'T' || p_brand AS type_name, CASE WHEN p_size % 10 = 0 THEN 'PATCH' ELSE p_name END AS name,
    p_size % 3 <> 0 AS can_read, p_partkey % 2 = 0 AS is_static, p_partkey FROM part)"""


def props(spark, d):
    return V.table(spark, d, "part").select(
        V.text("T", F.col("p_brand")).alias("type_name"),
        F.when(F.col("p_size") % 10 == 0, F.lit("PATCH")).otherwise(F.col("p_name")).alias("name"),
        (F.col("p_size") % 3 != 0).alias("can_read"),
        (F.col("p_partkey") % 2 == 0).alias("is_static"),
        "p_partkey",
    )


@query(
    "readable_props",
    f"""WITH {PROPS} SELECT p_partkey, name, 'shape' AS view FROM props_v WHERE can_read AND lower(name) <> 'patch'
    UNION ALL SELECT p_partkey, name, 'surface' FROM props_v WHERE can_read AND lower(name) <> 'patch' AND NOT is_static""",
)
def readable_props(spark, d):
    rows = props(spark, d)
    shape = C.readable_props(rows).select("p_partkey", "name", F.lit("shape").alias("view"))
    surface = C.readable_props(rows, surface=True).select("p_partkey", "name", F.lit("surface").alias("view"))
    return shape.unionByName(surface)


@query(
    "reflect_members",
    f"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || '.' || p_brand ELSE p_brand END AS type_name,
      'Get' || {V.PART_NAME} AS method FROM part WHERE p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 13 <> 0""",
)
def reflect_members(spark, d):
    size = F.col("p_size")
    rows = V.table(spark, d, "part").select(
        "p_partkey",
        F.lit("Ns").alias("namespace"),
        F.when(size % 2 == 0, F.col("p_type")).alias("declaring_type"),
        F.col("p_brand").alias("type_name"),
        F.when(size % 7 == 0, F.lit("ToString")).otherwise(F.concat(F.lit("Get"), V.part_name())).alias("method"),
        (size % 11 != 0).alias("is_public"),
        (size % 13 == 0).alias("is_special"),
    )
    return C.reflect_members(rows).select("p_partkey", "type_name", "method")


NOTE = """CASE others WHEN 0 THEN '' WHEN 1 THEN '// + 1 overload' ELSE '// + ' || others || ' overloads' END"""


@query(
    "collapse_overloads",
    f"""WITH {V.OVERLOADS}, g AS (SELECT type_name, method, arg_min(signature, (n_params, is_generic, pos)) AS signature,
      count(*) - 1 AS others FROM overloads_v GROUP BY type_name, method) SELECT *, {NOTE} AS note FROM g""",
)
def collapse_overloads(spark, d):
    return C.collapse_overloads(V.overloads(spark, d), "type_name")


@query(
    "expand_overloads",
    f"WITH {V.OVERLOADS} SELECT signature, n_params FROM overloads_v WHERE type_name = 'O5' AND method = 'A'",
)
def expand_overloads(spark, d):
    return C.expand_overloads(V.overloads(spark, d), "O5", "A").select("signature", "n_params")


@query(
    "collapse_ctors",
    f"""WITH {V.OVERLOADS}, g AS (SELECT type_name, n_params, arg_min(signature, pos) AS signature, count(*) - 1 AS others
      FROM (SELECT type_name, n_params, pos * 3 + CASE method WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pos, signature
            FROM overloads_v) x GROUP BY type_name, n_params)
    SELECT *, {NOTE} AS note FROM g""",
)
def collapse_ctors(spark, d):
    flag = F.when(F.col("method") == "A", 0).when(F.col("method") == "N", 1).otherwise(2)
    ctors = V.overloads(spark, d).withColumn("pos", F.col("pos") * 3 + flag)
    return C.collapse_ctors(ctors, "type_name")


@query(
    "method_signatures",
    f"WITH {V.OVERLOADS} SELECT type_name, signature, count(*) AS uses FROM overloads_v GROUP BY ALL",
)
def method_signatures(spark, d):
    return V.overloads(spark, d).groupBy("type_name", "signature").agg(F.count("*").alias("uses"))


@query(
    "type_info_lines",
    """SELECT p_partkey, concat_ws(' | ', CASE WHEN p_size % 2 = 0 THEN 'Extends: ' || p_brand END,
         CASE WHEN p_size % 3 = 0 THEN 'Implements: ' || p_type || ', ' || p_name END) AS tiered,
      concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'extends ' || p_brand END,
         CASE WHEN p_size % 3 = 0 THEN 'implements ' || p_type || ', ' || p_name END) AS simple FROM part""",
)
def type_info_lines(spark, d):
    base = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    interfaces = F.when(F.col("p_size") % 3 == 0, F.array("p_type", "p_name")).otherwise(
        F.array().cast("array<string>")
    )
    return V.table(spark, d, "part").select(
        "p_partkey",
        N.type_info(base, interfaces).alias("tiered"),
        N.type_info(base, interfaces, tiered=False).alias("simple"),
    )


@query(
    "method_keys",
    f"""WITH {V.METHODS}, c AS (SELECT *, count(*) OVER (PARTITION BY path, method_name) AS same_name FROM methods_v)
    SELECT *, CASE WHEN same_name > 1 THEN class_name || '::' || method_name ELSE method_name END AS method_key FROM c""",
)
def method_keys(spark, d):
    return C.method_keys(V.methods(spark, d), "path")


# Versions and frameworks --------------------------------------------------------

VERSIONS = """versions_v AS (
  SELECT p_brand || (p_partkey % 97) AS package, p_size AS major, p_partkey % 12 AS minor, p_partkey % 3 AS pre,
    p_size || '.' || (p_partkey % 12) || '.0' || CASE p_partkey % 3 WHEN 0 THEN '-rc.' || p_size ELSE '' END AS version
  FROM part)"""


def versions(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    tag = F.when(key % 3 == 0, V.text("-rc.", size)).otherwise(F.lit(""))
    return V.table(spark, d, "part").select(
        V.text(F.col("p_brand"), key % 97).alias("package"), V.text(size, ".", key % 12, ".0", tag).alias("version")
    )


@query("stable_versions", f"WITH {VERSIONS} SELECT package, version FROM versions_v WHERE pre <> 0")
def stable_versions(spark, d):
    return C.stable_versions(versions(spark, d))


@query(
    "latest_versions",
    f"""WITH {VERSIONS} SELECT package, arg_max(version, (major, minor)) AS version, 'stable' AS channel
      FROM versions_v WHERE pre <> 0 GROUP BY package
    UNION ALL SELECT package, arg_max(version, (major, minor, CASE WHEN pre = 0 THEN 0 ELSE 1 END)), 'all'
      FROM versions_v GROUP BY package""",
)
def latest_versions(spark, d):
    rows = versions(spark, d)
    stable = C.latest_version(rows).withColumn("channel", F.lit("stable"))
    return stable.unionByName(C.latest_version(rows, True).withColumn("channel", F.lit("all")))


ASSEMBLIES = """asm_v AS (
  SELECT p_brand || (p_partkey % 53) AS package, p_partkey,
    CASE p_size % 6 WHEN 0 THEN 'net8.0' WHEN 1 THEN 'net10.0' WHEN 2 THEN 'netstandard2.0' WHEN 3 THEN 'net48'
      WHEN 4 THEN 'net6.0' ELSE 'net35' END AS framework FROM part)"""


def assemblies(spark, d):
    size = F.col("p_size") % 6
    return V.table(spark, d, "part").select(
        V.text(F.col("p_brand"), F.col("p_partkey") % 53).alias("package"),
        "p_partkey",
        F.when(size == 0, "net8.0").when(size == 1, "net10.0").when(size == 2, "netstandard2.0")
        .when(size == 3, "net48").when(size == 4, "net6.0").otherwise("net35").alias("framework"),
    )


def pick_sql(requested: str | None) -> str:
    order = ([requested] if requested else []) + [f for f in C.FRAMEWORKS if f != requested]
    listed = ", ".join(f"'{f}'" for f in order)
    return f"""SELECT package, p_partkey, framework FROM (
      SELECT *, min(r) OVER (PARTITION BY package) AS best FROM (
        SELECT *, list_position([{listed}], framework) AS r FROM asm_v) x) y
      WHERE best IS NULL OR r = best"""


@query("pick_framework", f"WITH {ASSEMBLIES} {pick_sql(None)}")
def pick_framework(spark, d):
    return C.pick_framework(assemblies(spark, d))


@query("pick_requested_framework", f"WITH {ASSEMBLIES} {pick_sql('net48')}")
def pick_requested_framework(spark, d):
    return C.pick_framework(assemblies(spark, d), "net48")


@query(
    "publish_with_alias",
    f"""WITH {VERSIONS} SELECT package, v AS version, 'net10.0' AS framework, false AS includes_prerelease FROM (
      SELECT package, version AS v FROM versions_v UNION ALL SELECT package, 'latest' FROM versions_v) x""",
)
def publish_with_alias(spark, d):
    return C.publish_with_alias(versions(spark, d).withColumn("framework", F.lit("")), pinned=False)


DEPS = """dep_v AS (
  SELECT p_brand || (p_partkey % 53) AS package, p_name || p_partkey AS dependency, p_size || '.0' AS min_version,
    CASE p_size % 5 WHEN 0 THEN 'net8.0' WHEN 1 THEN 'net10.0' WHEN 2 THEN 'netstandard2.0' WHEN 3 THEN '' ELSE 'net6.0' END AS framework
  FROM part)"""


@query(
    "direct_dependencies",
    f"""WITH {DEPS}, g AS (SELECT package, arg_min(framework, r) AS framework FROM (
        SELECT *, CASE framework WHEN '' THEN 9 ELSE list_position([{', '.join(f"'{f}'" for f in C.FRAMEWORKS)}], framework) END AS r
        FROM dep_v) x WHERE r >= 3 GROUP BY package)
    SELECT package, framework, dependency, min_version AS version FROM dep_v JOIN g USING (package, framework)""",
)
def direct_dependencies(spark, d):
    size = F.col("p_size") % 5
    rows = V.table(spark, d, "part").select(
        V.text(F.col("p_brand"), F.col("p_partkey") % 53).alias("package"),
        V.text(F.col("p_name"), F.col("p_partkey")).alias("dependency"),
        V.text(F.col("p_size"), ".0").alias("min_version"),
        F.when(size == 0, "net8.0").when(size == 1, "net10.0").when(size == 2, "netstandard2.0")
        .when(size == 3, "").otherwise("net6.0").alias("framework"),
    )
    targets = rows.select("package").distinct().withColumn("framework", F.lit("net8.0"))
    return C.direct_dependencies(rows, targets)


@query(
    "split_cache_keys",
    """SELECT p_partkey, p_name AS package, CASE p_size % 3 WHEN 0 THEN 'unknown' ELSE p_size || '.0' END AS version,
      CASE p_size % 3 WHEN 2 THEN 'net9.0' ELSE 'unknown' END AS framework FROM part""",
)
def split_cache_keys(spark, d):
    size = F.col("p_size")
    key = F.when(size % 3 == 0, F.col("p_name")).when(size % 3 == 1, V.text(F.col("p_name"), "@", size, ".0")).otherwise(
        V.text(F.col("p_name"), "@", size, ".0@net9.0")
    )
    return V.table(spark, d, "part").select(
        "p_partkey", *[c.alias(n) for n, c in N.split_cache_key(key).items()]
    )


@query("entries_by_key", f"WITH {VERSIONS} SELECT package, version, 'net9.0' AS framework FROM versions_v ORDER BY ALL")
def entries_by_key(spark, d):
    return C.entries_by_key(versions(spark, d).withColumn("framework", F.lit("net9.0")))


@query(
    "search_catalogue",
    f"""WITH {V.MEMBERS}, p AS (SELECT name AS package, CAST(line AS VARCHAR) AS version, {tier_sql('name', 'ring')} AS score FROM members_v)
    SELECT * FROM p WHERE score > 0 ORDER BY score DESC, package, version LIMIT 30""",
)
def search_catalogue(spark, d):
    packages = V.members(spark, d).select(F.col("name").alias("package"), F.col("line").cast("string").alias("version"))
    return C.search_catalogue(packages, "ring", 30)


@query(
    "split_tags",
    """SELECT p_partkey, p_brand || '|' || split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) AS tags FROM part""",
)
def split_tags(spark, d):
    raw = F.concat(F.lit(" "), "p_brand", F.lit(", "), "p_name", F.lit(",,"))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(C.split_tags(raw), "|").alias("tags"))


# Type names -----------------------------------------------------------------

ALIASES = "['string', 'int', 'long', 'bool']"


@query(
    "simplify_type_names",
    f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Brand' || substr(p_brand, 7)
      WHEN 1 THEN {ALIASES}[p_size % 4 + 1]
      WHEN 2 THEN 'List<' || {ALIASES}[p_size % 4 + 1] || '>'
      WHEN 3 THEN 'Dictionary<' || {ALIASES}[p_size % 4 + 1] || ', List<Brand' || substr(p_brand, 7) || '>>'
      WHEN 4 THEN {ALIASES}[p_size % 4 + 1] || '?'
      WHEN 5 THEN 'Brand' || substr(p_brand, 7) || '[]'
      WHEN 6 THEN 'void' ELSE 'Task<Dictionary<List<int>, Brand' || substr(p_brand, 7) || '>>' END AS short FROM part""",
)
def simplify_type_names(spark, d):
    key = F.col("p_partkey") % 8
    lib = ", lib, Version=4.0.0.0, Culture=neutral"
    table = F.array(*[F.lit(n) for n in ("System.String", "System.Int32", "System.Int64", "System.Boolean")])
    alias = F.element_at(table, F.col("p_size") % 4 + 1)
    own = V.text("Shop.Brand", F.substring("p_brand", 7, 9))
    generic = "System.Collections.Generic."
    name = (
        F.when(key == 0, own)
        .when(key == 1, alias)
        .when(key == 2, V.text(generic, "List`1[[", alias, lib, "]]"))
        .when(key == 3, V.text(generic, "Dictionary`2[[", alias, lib, "],[", generic, "List`1[[", own, lib, "]]", lib, "]]"))
        .when(key == 4, V.text("System.Nullable`1[[", alias, lib, "]]"))
        .when(key == 5, V.text(own, "[]"))
        .when(key == 6, F.lit(""))
        .otherwise(
            V.text("System.Threading.Tasks.Task`1[[", generic, "Dictionary`2[[", generic, "List`1[[System.Int32", lib, "]]", lib,
                   "],[", own, lib, "]]", lib, "]]")
        )
    )
    return V.table(spark, d, "part").select("p_partkey", N.simplify_type_name(name).alias("short"))


# Inheritance ----------------------------------------------------------------

# each part derives from the part a tenth of its number; the roots derive from nothing known
@query(
    "inherited_properties",
    """WITH RECURSIVE up AS (SELECT p_partkey AS t, p_partkey AS anc, 0 AS depth FROM part
      UNION ALL SELECT t, anc // 10, depth + 1 FROM up WHERE anc >= 10),
    pr AS (SELECT p_partkey AS anc, p_brand AS name, p_type AS value_type FROM part
      UNION ALL SELECT p_partkey, 'Size' || (p_size % 3), 'int' FROM part)
    SELECT 'T' || t AS type_name, name, arg_min(value_type, depth) AS value_type, 'T' || arg_min(up.anc, depth) AS declared_in,
      min(depth) AS depth FROM up JOIN pr ON pr.anc = up.anc GROUP BY t, name""",
)
def inherited_properties(spark, d):
    part = V.table(spark, d, "part")
    key = F.col("p_partkey")
    name = V.text("T", key)
    base = F.when(key >= 10, V.text("T", F.floor(key / 10))).otherwise(F.lit("Elsewhere"))
    kinds = part.select(name.alias("type_name"), base.alias("base"))
    declared = part.select(
        name.alias("type_name"), F.col("p_brand").alias("name"), F.col("p_type").alias("value_type")
    ).unionByName(
        part.select(name.alias("type_name"), V.text("Size", F.col("p_size") % 3).alias("name"), F.lit("int").alias("value_type"))
    )
    return C.inherited_properties(kinds, declared)


# Manifests and docs ---------------------------------------------------------

MANIFEST = """man AS (SELECT p_type AS project, 'm/' || p_partkey || '.csproj' AS path, 'Sdk.' || p_type AS sdk,
  CASE p_size % 3 WHEN 0 THEN 'net9.0' WHEN 1 THEN 'net8.0;net10.0' ELSE 'Unknown' END AS framework, p_name, p_brand, p_size FROM part)"""


@query(
    "scan_manifests",
    f"""WITH {MANIFEST} SELECT project, path, sdk, framework, p_name AS package, p_size || '.0.1' AS version FROM man WHERE p_size % 2 = 0
    UNION ALL SELECT project, path, sdk, framework, p_brand, 'Unknown' FROM man WHERE p_size % 5 = 0
    UNION ALL SELECT project, path, sdk, framework, '-', '-' FROM man WHERE p_size % 2 <> 0 AND p_size % 5 <> 0""",
)
def scan_manifests(spark, d):
    rows = M.scan_manifests(V.manifests(spark, d))
    return rows.withColumn("package", F.coalesce("package", F.lit("-"))).withColumn(
        "version", F.coalesce("version", F.lit("-"))
    )


@query(
    "package_usage",
    f"""WITH {MANIFEST} SELECT project, path,
      (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS packages FROM man""",
)
def package_usage(spark, d):
    return M.package_usage(V.manifests(spark, d))


@query(
    "manifests_per_package",
    f"""WITH {MANIFEST} SELECT p_name AS package, count(*) AS manifests FROM man WHERE p_size % 2 = 0 GROUP BY 1
    UNION ALL SELECT p_brand, count(*) FROM man WHERE p_size % 5 = 0 GROUP BY 1""",
)
def manifests_per_package(spark, d):
    return M.manifests_per_package(V.manifests(spark, d))


DOCS = f"""docs_v AS (
  SELECT p_brand AS package, CASE WHEN p_size % 2 = 0 THEN 'latest' ELSE p_size || '.0' END AS version, 'lib/' || p_partkey || '.xml' AS path,
    'T:' || replace(p_brand, '#', '') || '.' || {V.PART_NAME} AS member_id, 'The Task of ' || p_name || ' x.' AS summary, '' AS returns,
    '' AS params, '' AS exceptions, p_partkey * 2 AS place FROM part WHERE p_size % 7 <> 0
  UNION ALL SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'latest' ELSE p_size || '.0' END, 'lib/' || p_partkey || '.xml',
    'M:' || replace(p_brand, '#', '') || '.' || {V.PART_NAME} || '.Run(System.Int32)', 'Runs n times.', 'a ' || p_size,
    'n=How <often>', 'T:System.Error=never', p_partkey * 2 + 1 FROM part WHERE p_size % 7 <> 0)"""


def member_docs(spark, d):
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    docs = D.scan_member_docs(V.doc_files(spark, d))
    return docs.select(
        "package", "version", "path", "member_id", "summary",
        F.coalesce("returns", F.lit("")).alias("returns"),
        shown("params").alias("params"), shown("exceptions").alias("exceptions"),
    )


DOC_COLUMNS = "package, version, path, member_id, summary, returns, params, exceptions"


@query("scan_member_docs", f"WITH {DOCS} SELECT {DOC_COLUMNS} FROM docs_v")
def scan_member_docs(spark, d):
    return member_docs(spark, d)


@query(
    "first_wins_merge",
    f"""WITH {DOCS} SELECT arg_min(member_id, path) AS member_id, arg_min(summary, path) AS summary, min(path) AS path, package, version
    FROM docs_v GROUP BY package, version, lower(member_id)""",
)
def first_wins_merge(spark, d):
    entries = member_docs(spark, d).select("package", "version", "member_id", "summary", "path")
    merged = C.first_wins_merge(entries, ["package", "version", "member_id"], ["path"])
    return merged.select("package", "version", "member_id", "summary", "path")


@query(
    "resolve_docs",
    f"""WITH {DOCS} SELECT {DOC_COLUMNS}, 'dotted' AS asked FROM docs_v
      WHERE contains(lower(member_id), '.smallring.run(')
    UNION ALL SELECT {DOC_COLUMNS}, 'short' FROM docs_v WHERE ends_with(lower(member_id), '.smallring')""",
)
def resolve_docs(spark, d):
    docs = member_docs(spark, d)
    dotted = C.resolve_docs(docs, " SmallRing.RUN ").withColumn("asked", F.lit("dotted"))
    return dotted.unionByName(C.resolve_docs(docs, "smallring").withColumn("asked", F.lit("short")))


@query(
    "docs_for_member",
    f"""WITH {DOCS}, r AS (SELECT DISTINCT p_brand AS package, p_size || '.0' AS version FROM part),
    c AS (SELECT r.package, r.version, CASE WHEN EXISTS (SELECT 1 FROM docs_v d WHERE d.package = r.package AND d.version = r.version)
        THEN r.version ELSE 'latest' END AS found_version FROM r)
    SELECT c.package, c.version, c.found_version, path, member_id FROM c
    JOIN docs_v d ON d.package = c.package AND d.version = c.found_version""",
)
def docs_for_member(spark, d):
    part = V.table(spark, d, "part")
    requests = part.select(F.col("p_brand").alias("package"), V.text(F.col("p_size"), ".0").alias("version"))
    return C.docs_for_member(member_docs(spark, d), requests).select(
        "package", "version", "found_version", "path", "member_id"
    )
