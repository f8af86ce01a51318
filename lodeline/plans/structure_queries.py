"""Queries for structure extraction from source text and pages."""

from pyspark.sql import functions as F

from lodeline.functions import naming as N
from lodeline.operators import callgraph as G
from lodeline.operators import inventory as I
from lodeline.operators import structure as S
from lodeline.operators.search import search
from lodeline.plans import views as V
from lodeline.plans.registered import query
from lodeline.session import stored

SRC = f"WITH {V.SOURCE_PARTS}"


@query(
    "extract_types",
    f"""{SRC} SELECT project, path, name AS type_name, 'class' AS kind, 'public' AS modifiers, 'Base' || brand AS base,
        'IPart, IStore<int>' AS interfaces, 6 AS line,
        'Extends: Base' || brand || ' | Implements: IPart, IStore<int>' AS info FROM src
      UNION ALL SELECT project, path, 'Inner', 'class', 'public', '', '', inner_at, '' FROM src WHERE nested > 0
      UNION ALL SELECT project, path, 'I' || name, 'interface', 'public', '', 'IPart', face_at, 'Implements: IPart' FROM src""",
)
def extract_types(spark, d):
    types = S.extract_types(V.sources(spark, d))
    return types.select(
        "project", "path", "type_name", "kind", F.array_join("modifiers", " ").alias("modifiers"),
        F.coalesce("base", F.lit("")).alias("base"), F.array_join("interfaces", ", ").alias("interfaces"), "line",
        N.type_info(F.col("base"), F.col("interfaces")).alias("info"),
    )


@query(
    "extract_methods",
    f"""{SRC} SELECT project, path, name AS type_name, price AS name, 'public virtual' AS modifiers,
        'decimal ' || price || '(int qty, string unit = "kg")' AS signature, http_at AS line_start, http_at + 6 + spread AS line_end FROM src
      UNION ALL SELECT project, path, name, 'Reset', 'private static', 'void Reset()', reset_at, reset_at FROM src
      UNION ALL SELECT project, path, 'Inner', 'Deep', 'public', 'void Deep()', inner_at + 2, inner_at + 2 FROM src WHERE nested > 0
      UNION ALL SELECT project, path, 'I' || name, 'Count', 'public', 'int Count(List<int> items)', face_at + 2, face_at + 2 FROM src""",
)
def extract_methods(spark, d):
    return S.extract_methods(V.sources(spark, d)).select(
        "project", "path", "type_name", "name", F.array_join("modifiers", " ").alias("modifiers"),
        N.method_signature(F.col("returns"), F.col("name"), F.col("params")).alias("signature"),
        "line_start", "line_end",
    )


@query(
    "extract_properties",
    f"""{SRC} SELECT project, path, name AS type_name, 'Size' AS name, 'int' AS value_type, 'public' AS modifiers,
        'get; set;' AS accessors, '// Lines ' || key_at || '-' || (key_at + 1) AS label FROM src
      UNION ALL SELECT project, path, name, 'Label', 'string', 'public', '', '// Line ' || (key_at + 2) FROM src
      UNION ALL SELECT project, path, 'I' || name, 'Title', 'string', 'public', 'get;', '// Line ' || (face_at + 3) FROM src""",
)
def extract_properties(spark, d):
    return S.extract_properties(V.sources(spark, d)).select(
        "project", "path", "type_name", "name", "value_type", F.array_join("modifiers", " ").alias("modifiers"),
        N.accessor_string(F.col("has_getter"), F.col("has_setter")).alias("accessors"),
        N.line_label(F.col("line_start"), F.col("line_end")).alias("label"),
    )


@query(
    "extract_fields",
    f"""{SRC}, f AS (SELECT '_size' AS name, 'int' AS value_type, true AS is_readonly, false AS is_const, 0 AS below, 0 AS least
        UNION ALL SELECT '_code', 'int', true, false, 0, 0 UNION ALL SELECT 'Kind', 'string', false, true, 1, 0
        UNION ALL SELECT '_t' || (i - 1), 'int[]', false, false, 1 + i, i FROM (SELECT unnest([1, 2, 3, 4]) AS i) x)
      SELECT project, path, src.name AS type_name, f.name, value_type, is_readonly, false AS is_static, is_const,
        fields_at + below AS line_start FROM src JOIN f ON extra >= least""",
)
def extract_fields(spark, d):
    return S.extract_fields(V.sources(spark, d)).select(
        "project", "path", "type_name", "name", "value_type", "is_readonly", "is_static", "is_const", "line_start"
    )


@query(
    "extract_attributes",
    f"""{SRC} SELECT project, path, name AS type_name, '' AS parent_member, 'Table' AS name,
        'arg0=' || p_name || ';Schema=s' || p_size AS args, 6 AS line FROM src
      UNION ALL SELECT project, path, name, 'Size', 'Key', '', key_at FROM src
      UNION ALL SELECT project, path, name, price, 'HttpGet', 'arg0=parts/' || k, http_at FROM src""",
)
def extract_attributes(spark, d):
    shown = F.transform(F.map_entries("args"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return S.extract_attributes(V.sources(spark, d)).select(
        "project", "path", "type_name", F.coalesce("parent_member", F.lit("")).alias("parent_member"), "name",
        F.array_join(shown, ";").alias("args"), "line",
    )


@query(
    "extract_ctor_params",
    f"""{SRC} SELECT project, path, name AS type_name, 0 AS pos, 'IStore<' || brand || '>' AS type, 'store' AS name,
        '' AS "default" FROM src
      UNION ALL SELECT project, path, name, 1, 'string', 'label', '"x"' FROM src""",
)
def extract_ctor_params(spark, d):
    params = S.extract_ctor_params(V.sources(spark, d))
    return params.withColumn("default", F.coalesce("default", F.lit("")))


@query(
    "extract_imports",
    f"""{SRC} SELECT project, path, p_type || '.Parts' AS namespace, 'System,' || brand || '.Core' AS usings FROM src""",
)
def extract_imports(spark, d):
    return S.extract_imports(V.sources(spark, d)).withColumn("usings", F.array_join("usings", ","))


BODY = """'            this.Check(qty);' || chr(10) || '            var rate = _table.Inner.Find(base.Scale(qty));' || chr(10)
        || '            return Math.Round(rate);' || chr(10) || CASE WHEN k % 6 = 0 THEN '              }' ELSE '        }' END"""
HEAD = """'        [HttpGet("parts/' || k || '")]' || chr(10) || '        public virtual decimal ' || price
        || CASE WHEN spread > 0 THEN '(' || chr(10) || '            int qty,' || chr(10) || '            string unit = "kg")'
           ELSE '(int qty, string unit = "kg")' END || chr(10) || '        {' || chr(10)"""


@query(
    "extract_bodies",
    f"""{SRC} SELECT project, path, name || '::' || price || '::' || http_at AS key, true AS is_virtual,
        false AS is_static, {HEAD} || {BODY} AS full_code, {BODY} AS body FROM src
      UNION ALL SELECT project, path, name || '::Reset::' || reset_at, false, true,
        '        private static void Reset() => Clear();', '' FROM src
      UNION ALL SELECT project, path, 'Inner::Deep::' || (inner_at + 2), false, false,
        '            public void Deep() {{ Run<int>(); a.Reset<List<int>>(1); }}', '' FROM src WHERE nested > 0
      UNION ALL SELECT project, path, 'I' || name || '::Count::' || (face_at + 2), false, false,
        '        int Count(List<int> items);', '' FROM src""",
)
def extract_bodies(spark, d):
    return S.extract_bodies(V.sources(spark, d)).select(
        "project", "path", "key", "is_virtual", "is_static", "full_code", "body"
    )


@query(
    "extract_call_sites",
    f"""{SRC}, c AS (SELECT 'Check' AS callee_method, 'SameClass' AS callee_class, 3 AS below
        UNION ALL SELECT 'Find', '_table', 4 UNION ALL SELECT 'Scale', 'BaseClass', 4 UNION ALL SELECT 'Round', 'Math', 5)
      SELECT project, path, name AS caller_class, price AS caller_method, callee_method, callee_class, http_at + spread + below AS line
      FROM src CROSS JOIN c
      UNION ALL SELECT project, path, name, 'Reset', 'Clear', 'SameClass', reset_at FROM src
      UNION ALL SELECT project, path, 'Inner', 'Deep', 'Reset', 'a', inner_at + 2 FROM src WHERE nested > 0""",
)
def extract_call_sites(spark, d):
    calls = S.extract_call_sites(V.sources(spark, d))
    return calls.select(
        "project", "path", "caller_class", "caller_method", "callee_method",
        S.resolve_receiver(F.col("receiver")).alias("callee_class"), "line",
    )


@query("resolve_receivers", f"WITH {V.CALLS} SELECT callee_class, count(*) AS calls FROM calls_v GROUP BY ALL")
def resolve_receivers(spark, d):
    resolved = S.resolve_receiver(F.col("receiver")).alias("callee_class")
    return V.receivers(spark, d).select(resolved).groupBy("callee_class").agg(F.count("*").alias("calls"))


@query(
    "visibility_view",
    f"""{SRC} SELECT project, path, price AS name FROM src UNION ALL SELECT project, path, 'Count' FROM src
      UNION ALL SELECT project, path, 'Deep' FROM src WHERE nested > 0""",
)
def visibility_view(spark, d):
    return S.visibility_view(S.extract_methods(V.sources(spark, d))).select("project", "path", "name")


@query(
    "member_index",
    f"""{SRC}, m AS (
      SELECT project, path, '' AS parent, 'Class' AS member_type, name, 6 AS line FROM src
      UNION ALL SELECT project, path, name, 'Interface', unnest(['IPart', 'IStore<int>']), 6 FROM src
      UNION ALL SELECT project, path, name, 'Method', price, http_at FROM src
      UNION ALL SELECT project, path, name, 'Method', 'Reset', reset_at FROM src
      UNION ALL SELECT project, path, name, 'Property', 'Size', key_at FROM src
      UNION ALL SELECT project, path, name, 'Property', 'Label', key_at + 2 FROM src
      UNION ALL SELECT project, path, name, 'Field', unnest(['_size', '_code']), fields_at FROM src
      UNION ALL SELECT project, path, name, 'Field', 'Kind', fields_at + 1 FROM src
      UNION ALL SELECT project, path, name, 'Field', '_t' || i, fields_at + 2 + i
        FROM src JOIN (SELECT unnest([0, 1, 2, 3]) AS i) x ON i < extra
      UNION ALL SELECT project, path, name, 'Attribute', 'Table', 6 FROM src
      UNION ALL SELECT project, path, name, 'Attribute', 'Key', key_at FROM src
      UNION ALL SELECT project, path, name, 'Attribute', 'HttpGet', http_at FROM src
      UNION ALL SELECT project, path, '', 'Class', 'Inner', inner_at FROM src WHERE nested > 0
      UNION ALL SELECT project, path, 'Inner', 'Method', 'Deep', inner_at + 2 FROM src WHERE nested > 0
      UNION ALL SELECT project, path, '', 'Class', 'I' || name, face_at FROM src
      UNION ALL SELECT project, path, 'I' || name, 'Interface', 'IPart', face_at FROM src
      UNION ALL SELECT project, path, 'I' || name, 'Method', 'Count', face_at + 2 FROM src
      UNION ALL SELECT project, path, 'I' || name, 'Property', 'Title', face_at + 3 FROM src)
    SELECT * REPLACE (CAST(line AS BIGINT) AS line) FROM m""",
)
def member_index(spark, d):
    return S.member_index(V.sources(spark, d)).withColumn("parent", F.coalesce("parent", F.lit("")))


@query("file_index", f"{SRC} SELECT project, path, 2 + nested // 4 AS types, 3 + nested // 4 AS methods FROM src")
def file_index(spark, d):
    files = V.sources(spark, d)
    read = stored(S.members(files).where("what in ('Class', 'Method')"))
    return I.file_index(S.extract_types(files, read), S.extract_methods(files, read))


# From source text to answers ---------------------------------------------------


@query(
    "source_search",
    f"""{SRC}, n AS (SELECT count(*) AS total FROM src)
    SELECT project, path, name AS parent, 'Method' AS member_type, price AS name, CAST(http_at + 4 + spread AS BIGINT) AS line, 0.8::DOUBLE AS score,
      1 AS page, CAST(ceil(total / 20.0) AS INTEGER) AS total_pages, total AS total_results
    FROM src, n ORDER BY price, project, path LIMIT 20""",
)
def source_search(spark, d):
    """Ranked search over the members and bodies that were read from source text."""
    files = V.sources(spark, d)
    read = stored(S.members(files))
    return search(S.member_index(files, read), S.extract_bodies(files, read), "_table.Inner.Find")


@query(
    "source_call_graph",
    f"""{SRC} SELECT * FROM (SELECT 'caller' AS direction, path, 'Inner' AS class_name, 'Deep' AS method_name, inner_at + 2 AS line
      FROM src WHERE nested > 0 AND path <> 'src/1.cs' ORDER BY path LIMIT 20) x
    UNION ALL SELECT 'callee', path, 'SameClass', 'Clear', reset_at FROM src WHERE path = 'src/1.cs'""",
)
def source_call_graph(spark, d):
    """Callers and callees of a method over the calls that were read from source text."""
    calls = S.extract_call_sites(V.sources(spark, d)).withColumn("callee_class", S.resolve_receiver(F.col("receiver")))
    calls = stored(calls)  # read once from the source, then counted, joined and listed
    owner = V.table(spark, d, "part").where("p_partkey = 1").select(V.text(V.part_name(), F.col("p_partkey"))).first()[0]
    return G.call_graph(calls, "src/1.cs", owner, "Reset")


# Pages ----------------------------------------------------------------------

PAGE_TAGS = V.PAGES + r""", tags AS (
  SELECT page_id, unnest(range(1, len(t) + 1)) AS tag_no, unnest(t) AS tag
  FROM (SELECT page_id, regexp_extract_all(content, '<[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?>') AS t FROM pages_v) x)"""


def numbered_pages(spark, d):
    return V.pages(spark, d).select("project", F.col("page_id").alias("path"), "content")


@query(
    "page_tags",
    f"WITH {PAGE_TAGS} SELECT page_id, tag_no, lower(regexp_extract(tag, '<([A-Za-z0-9]+)', 1)) AS tag FROM tags",
)
def page_tags(spark, d):
    return S.page_tags(numbered_pages(spark, d)).select(F.col("path").alias("page_id"), "tag_no", "tag")


@query(
    "tag_attributes",
    f"""WITH {PAGE_TAGS}, a AS (SELECT page_id, tag_no, unnest(regexp_extract_all(tag, '([A-Za-z-]+)="([^"]*)"')) AS a FROM tags)
    SELECT page_id, tag_no, lower(regexp_extract(a, '^([^=]+)', 1)) AS name, regexp_extract(a, '"(.*)"$', 1) AS value FROM a""",
)
def tag_attributes(spark, d):
    return S.tag_attributes(numbered_pages(spark, d)).select(F.col("path").alias("page_id"), "tag_no", "name", "value")


PAGE_LINKS = V.PAGES + r""", links AS (
  SELECT project, page_id, unnest(regexp_extract_all(content, '<a\s[^>]*href="([^"]*)"', 1)) AS target FROM pages_v)"""


@query("page_links", f"WITH {PAGE_LINKS} SELECT page_id, target, count(*) AS links FROM links GROUP BY ALL")
def page_links(spark, d):
    return (
        S.page_links(numbered_pages(spark, d))
        .groupBy(F.col("path").alias("page_id"), "target")
        .agg(F.count("*").alias("links"))
    )


@query("distinct_links", f"WITH {PAGE_LINKS} SELECT DISTINCT project, target FROM links")
def distinct_links(spark, d):
    return S.page_links(numbered_pages(spark, d)).select("project", "target").distinct()


@query(
    "page_text",
    r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'),
        '\s+', ' ', 'g')), ''), '-') AS text FROM pages""",
)
def page_text(spark, d):
    return V.table(spark, d, "pages").select(
        "page_id", F.coalesce(N.markup_to_text(F.col("html")), F.lit("-")).alias("text")
    )


@query(
    "page_file_index",
    f"""WITH {PAGE_TAGS} SELECT page_id, count(DISTINCT lower(regexp_extract(tag, '<([A-Za-z0-9]+)', 1))) AS kinds,
      count(*) AS tags FROM tags GROUP BY page_id""",
)
def page_file_index(spark, d):
    per_kind = S.page_tags(numbered_pages(spark, d)).groupBy("path", "tag").agg(F.count("*").alias("n"))
    return per_kind.groupBy(F.col("path").alias("page_id")).agg(
        F.count("*").alias("kinds"), F.sum("n").alias("tags")
    )


@query(
    "member_id_parts",
    r"""WITH t AS (SELECT page_id, 'M:' || replace(regexp_extract(url, '^https?://([^/]+)', 1), '/', '.') || '.Run' || page_id
        || '(System.Int32,System.String)' AS id FROM pages)
    SELECT page_id, 'M' AS kind, list_extract(string_split(regexp_extract(id, '^M:(.*)\(', 1), '.'), -2) AS type_segment,
      'Run' || page_id AS short_name FROM t""",
)
def member_id_parts(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    member = V.text("M:", host, ".Run", F.col("page_id"), "(System.Int32,System.String)")
    return V.table(spark, d, "pages").select(
        "page_id", *[c.alias(n) for n, c in N.member_id_parts(member).items()]
    )
