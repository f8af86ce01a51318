"""Views that read the given tables as the model's tables.

Each view stands here twice: as a DataFrame for Spark and as a common table
expression for the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.naming import method_signature
from lodeline.functions.text import epoch_micros
from lodeline.operators.lines import explode_lines
from lodeline.operators.structure import resolve_receiver


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    """Strings and columns joined; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# documents as files ---------------------------------------------------------

FILES = """files_v AS (
  SELECT source AS project, lang || '/' || doc_id || '.txt' AS path, text AS content,
         strlen(text) AS size_bytes, doc_id, lang
  FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"),
        text(F.col("lang"), "/", F.col("doc_id"), ".txt").alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        "doc_id",
        "lang",
    )


LINES = """lines_v AS (
  SELECT project, path, line_no, rtrim(raw, chr(13)) AS line
  FROM (SELECT project, path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no,
               unnest(string_split(content, chr(10))) AS raw FROM files_v) x)"""

# pages ----------------------------------------------------------------------

PAGES = r"""pages_v AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS project,
         regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path,
         html AS content, strlen(html) AS size_bytes, page_id, url
  FROM pages)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("project"),
        F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path"),
        F.col("html").alias("content"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        "page_id",
        "url",
    )


# Paths that reach every access rule, made from the pages -----------------------

TREE = r"""tree_v AS (
  SELECT project, page_id, size_bytes, content,
    CASE page_id % 13
      WHEN 0 THEN 'bin/' || path || '.cs'
      WHEN 1 THEN 'src\' || path || '/appsettings.json'
      WHEN 2 THEN path || '/my-secret.txt'
      WHEN 3 THEN path || '/a.private.cs'
      WHEN 4 THEN path || '/Tokenizer.cs'
      WHEN 5 THEN path || '/Dockerfile'
      WHEN 6 THEN path || '/data.json'
      WHEN 7 THEN '../' || path || '/x.cs'
      WHEN 8 THEN 'Tests/' || path || '/a.cs'
      WHEN 9 THEN 'private/' || path || '/Program.cs'
      WHEN 10 THEN path || '/../notes.MD'
      WHEN 11 THEN path || '/key.pem'
      ELSE path || '/index.html' END AS path
  FROM pages_v)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    shapes = [
        text("bin/", path, ".cs"),
        text("src\\", path, "/appsettings.json"),
        text(path, "/my-secret.txt"),
        text(path, "/a.private.cs"),
        text(path, "/Tokenizer.cs"),
        text(path, "/Dockerfile"),
        text(path, "/data.json"),
        text("../", path, "/x.cs"),
        text("Tests/", path, "/a.cs"),
        text("private/", path, "/Program.cs"),
        text(path, "/../notes.MD"),
        text(path, "/key.pem"),
    ]
    chosen = F.when(F.col("page_id") % 13 == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        chosen = chosen.when(F.col("page_id") % 13 == i, shape)
    return pages(spark, sf_dir).select(
        "project",
        "page_id",
        "size_bytes",
        "content",
        chosen.otherwise(text(path, "/index.html")).alias("path"),
    )


# parts as members -----------------------------------------------------------

_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
PART_NAME = (
    f"upper(left({_FIRST}, 1)) || substr({_FIRST}, 2) || upper(left({_SECOND}, 1)) || substr({_SECOND}, 2)"
)

MEMBERS = f"""members_v AS (
  SELECT p_type AS project, 'src/' || (p_partkey // 20) || '.cs' AS path, p_brand AS parent,
         CASE p_size % 5 WHEN 0 THEN 'Class' WHEN 1 THEN 'Method' WHEN 2 THEN 'Property'
                         WHEN 3 THEN 'Field' ELSE 'Attribute' END AS member_type,
         {PART_NAME} || CASE WHEN p_size % 5 = 4 AND p_size % 2 = 0 THEN 'Attribute' ELSE '' END AS name,
         p_partkey AS line
  FROM part)"""


def part_name() -> Column:
    return F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 5
    suffix = F.when((kind == 4) & (F.col("p_size") % 2 == 0), F.lit("Attribute")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("project"),
        text("src/", F.floor(F.col("p_partkey") / 20), ".cs").alias("path"),
        F.col("p_brand").alias("parent"),
        F.when(kind == 0, "Class").when(kind == 1, "Method").when(kind == 2, "Property")
        .when(kind == 3, "Field").otherwise("Attribute").alias("member_type"),
        F.concat(part_name(), suffix).alias("name"),
        F.col("p_partkey").alias("line"),
    )


# conversations as method bodies ------------------------------------------------

BODIES = """bodies_v AS (
  SELECT role AS project, CAST(conv_id AS VARCHAR) AS path, 'C' || conv_id AS class_name,
         'turn' || turn AS method_name, text AS full_code, turn * 100 + 1 AS line
  FROM conversations)"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("role").alias("project"),
        F.col("conv_id").cast("string").alias("path"),
        text("C", F.col("conv_id")).alias("class_name"),
        text("turn", F.col("turn")).alias("method_name"),
        F.col("text").alias("full_code"),
        (F.col("turn") * 100 + 1).alias("line"),
    )


# line items as calls --------------------------------------------------------

CALLS = """calls_v AS (
  SELECT 'o/' || l_orderkey || '.cs' AS path, 'S' || l_suppkey AS caller_class,
         'M' || l_linenumber AS caller_method, 'P' || l_partkey AS callee_method,
         CASE l_returnflag WHEN 'A' THEN 'SameClass' WHEN 'N' THEN 'System' ELSE
           CASE WHEN l_linestatus = 'F' THEN 'Unknown' ELSE 'store' END END AS callee_class,
         CAST(l_quantity AS INT) AS line
  FROM lineitem)"""


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        text("o/", F.col("l_orderkey"), ".cs").alias("path"),
        text("S", F.col("l_suppkey")).alias("caller_class"),
        text("M", F.col("l_linenumber")).alias("caller_method"),
        text("P", F.col("l_partkey")).alias("callee_method"),
        F.when(flag == "A", F.lit("this._inner"))
        .when(flag == "N", F.lit("System.IO.File"))
        .when(status == "F", F.lit(None))
        .otherwise(F.lit("store"))
        .alias("receiver"),
        F.col("l_quantity").cast("int").alias("line"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receivers(spark, sf_dir).select(
        "path",
        "caller_class",
        "caller_method",
        "callee_method",
        resolve_receiver(F.col("receiver")).alias("callee_class"),
        "line",
    )


METHODS = """methods_v AS (
  SELECT 'o/' || l_orderkey || '.cs' AS path, 'S' || l_suppkey AS class_name,
         'M' || l_linenumber AS method_name, CAST(l_quantity AS INT) AS line
  FROM lineitem)"""


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select(
        "path",
        F.col("caller_class").alias("class_name"),
        F.col("caller_method").alias("method_name"),
        "line",
    )


# line items as overloads ----------------------------------------------------

OVERLOADS = """overloads_v AS (
  SELECT 'O' || l_orderkey AS type_name, l_returnflag AS method, l_linenumber AS n_params,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_generic,
         l_partkey * 1000000 + l_suppkey AS pos,
         'decimal ' || l_returnflag || '(P' || l_partkey || ' p, S' || l_suppkey || ' s)' AS signature
  FROM lineitem)"""


def overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.array(
        F.struct(
            text("P", F.col("l_partkey")).alias("type"),
            F.lit("p").alias("name"),
            F.lit(None).cast("string").alias("default"),
        ),
        F.struct(
            text("S", F.col("l_suppkey")).alias("type"),
            F.lit("s").alias("name"),
            F.lit(None).cast("string").alias("default"),
        ),
    )
    return table(spark, sf_dir, "lineitem").select(
        text("O", F.col("l_orderkey")).alias("type_name"),
        F.col("l_returnflag").alias("method"),
        F.col("l_linenumber").alias("n_params"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("is_generic"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("pos"),
        method_signature(F.lit("decimal"), F.col("l_returnflag"), params, defaults=False).alias("signature"),
    )


# line items as a compiler log -----------------------------------------------

LOG_ORDER = ["build", "seq", "l_suppkey", "l_partkey", "l_extendedprice"]

DIAGNOSTICS = r"""diag_v AS (
  SELECT l_orderkey AS build, l_linenumber AS seq, l_suppkey, l_partkey, l_extendedprice,
         CASE WHEN l_returnflag = 'N' THEN 'warning' ELSE 'error' END AS severity,
         'CS' || (l_suppkey % 10) AS code, 'src/F' || l_partkey || '.cs' AS file,
         l_linenumber AS line, CAST(l_suppkey AS INT) AS col,
         'value ' || CAST(l_quantity AS INT) || ' is wrong' AS message
  FROM lineitem WHERE l_linenumber <> 7)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flag = c("l_returnflag")
    diagnostic = text(
        F.when(c("l_linestatus") == "F", F.lit("src\\F")).otherwise(F.lit("/src/F")),
        c("l_partkey"),
        ".cs(",
        c("l_linenumber"),
        ",",
        c("l_suppkey"),
        "): ",
        F.when(flag == "A", F.lit("error")).when(flag == "N", F.lit("warning")).otherwise(F.lit("ERROR")),
        " CS",
        c("l_suppkey") % 10,
        ": value ",
        c("l_quantity").cast("int"),
        " is wrong",
        F.when(c("l_suppkey") % 2 == 0, F.lit(" [app.csproj]")).otherwise(F.lit("")),
    )
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("build"),
        c("l_linenumber").alias("seq"),
        "l_suppkey",
        "l_partkey",
        "l_extendedprice",
        F.when(
            c("l_linenumber") == 7, text("  Determining projects to restore ", c("l_partkey"))
        ).otherwise(diagnostic).alias("line"),
    )


# events as changes ----------------------------------------------------------

CHANGES = """changes_v AS (
  SELECT event_id, 'p' || (user_id % 7) AS project, 'u/' || user_id || '.cs' AS path,
         'u/' || user_id || '_old.cs' AS old_path, user_id,
         CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted'
                         WHEN 'purchase' THEN 'renamed' ELSE 'changed' END AS action,
         epoch_us(ts) AS at_us, ts
  FROM events)"""


def changes(source: DataFrame) -> DataFrame:
    """Change events from the events table or a stream of it."""
    kind = F.col("event_type")
    return source.select(
        "event_id",
        text("p", F.col("user_id") % 7).alias("project"),
        text("u/", F.col("user_id"), ".cs").alias("path"),
        text("u/", F.col("user_id"), "_old.cs").alias("old_path"),
        "user_id",
        F.when(kind == "signup", "created").when(kind == "error", "deleted")
        .when(kind == "purchase", "renamed").otherwise("changed").alias("action"),
        epoch_micros(F.col("ts")).alias("at_us"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


# Patches made from the lines of each document -----------------------------------

PATCHES = """patches_v AS (
  SELECT path, line_no AS seq,
         CASE WHEN line_no % 4 = 1 THEN 'patch' WHEN line_no % 8 = 7 THEN 'delete' ELSE 'insert' END AS action,
         CAST(line_no AS INT) AS start_line, CAST(line_no AS INT) AS end_line,
         CASE WHEN line_no % 8 = 7 THEN NULL ELSE 'new ' || line_no || chr(10) || 'more' END AS content
  FROM lines_v WHERE line_no % 4 = 1 OR line_no % 4 = 3
  UNION ALL
  SELECT path, 1000000, 'append', 0, 0, 'the end' FROM files_v WHERE doc_id % 2 = 0
  UNION ALL
  SELECT path, 1000001, 'delete', 1000000, 1000000, NULL FROM files_v WHERE doc_id % 10 = 3
  UNION ALL
  SELECT path, 1000002, 'patch', 1, 1, 'again' FROM files_v WHERE doc_id % 10 = 5
  UNION ALL
  SELECT path || '.gone', 1, 'insert', 0, 0, 'first' FROM files_v WHERE doc_id % 10 = 7)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir)
    n = F.col("line_no")
    lines = explode_lines(docs, "path").where((n % 4 == 1) | (n % 4 == 3))
    deletes = n % 8 == 7
    edits = lines.select(
        "path",
        n.cast("bigint").alias("seq"),
        F.when(n % 4 == 1, "patch").when(deletes, "delete").otherwise("insert").alias("action"),
        n.alias("start_line"),
        n.alias("end_line"),
        F.when(~deletes, text("new ", n, "\nmore")).alias("content"),
    )

    def extra(where: str, path: Column, seq: int, action: str, start: int, end: int, content: str | None):
        return docs.where(where).select(
            path.alias("path"),
            F.lit(seq).cast("bigint").alias("seq"),
            F.lit(action).alias("action"),
            F.lit(start).alias("start_line"),
            F.lit(end).alias("end_line"),
            F.lit(content).cast("string").alias("content"),
        )

    path = F.col("path")
    return (
        edits.unionByName(extra("doc_id % 2 = 0", path, 1000000, "append", 0, 0, "the end"))
        .unionByName(extra("doc_id % 10 = 3", path, 1000001, "delete", 1000000, 1000000, None))
        .unionByName(extra("doc_id % 10 = 5", path, 1000002, "patch", 1, 1, "again"))
        .unionByName(extra("doc_id % 10 = 7", text(path, ".gone"), 1, "insert", 0, 0, "first"))
    )


# Source text made from the parts ------------------------------------------------


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part, in a layout that its key chooses.

    By the key, the attribute of the type stands on its line or before it, there
    are 0 to 4 fields with values in braces, a nested type or none, parameters on
    one line or several, and a closing brace at an odd indent.
    """
    name, key, brand = part_name(), F.col("p_partkey"), F.replace("p_brand", F.lit("#"), F.lit(""))
    attribute = text('    [Table("', F.col("p_name"), '", Schema = "s', F.col("p_size"), '")]')
    head = text("public class ", name, key, " : Base", brand, ", IPart, IStore<int>")
    inline, nested, spread = key % 2 == 1, key % 4 == 0, key % 3 == 1
    lines = [
        text("using System;"),
        text("using ", brand, ".Core;"),
        text("using System;"),
        text("namespace ", F.col("p_type"), ".Parts"),
        text("{"),
        F.when(inline, text(attribute, " ", head)).otherwise(attribute),
        F.when(~inline, text("    ", head)),
        text("    {"),
        text("        private readonly int _size, _code = ", F.col("p_size"), ";"),
        text("        public const string Kind = \"", F.col("p_type"), "\";"),
        *[F.when(key % 5 > i, text(f"        private int[] _t{i} = {{ 1, {i} }};")) for i in range(4)],
        text("        public ", name, key, "(IStore<", brand, "> store, string label = \"x\")"),
        text("        {"),
        text("            Register(store);"),
        text("        }"),
        F.when(nested, text("        public class Inner")),
        F.when(nested, text("        {")),
        F.when(nested, text("            public void Deep() { Run<int>(); a.Reset<List<int>>(1); }")),
        F.when(nested, text("        }")),
        text("        [Key]"),
        text("        public int Size { get; set; }"),
        text("        public string Label => Kind;"),
        text("        [HttpGet(\"parts/", key, "\")]"),
        text("        public virtual decimal Price", key % 7, F.when(spread, "(").otherwise("(int qty, string unit = \"kg\")")),
        F.when(spread, text("            int qty,")),
        F.when(spread, text("            string unit = \"kg\")")),
        text("        {"),
        text("            this.Check(qty);"),
        text("            var rate = _table.Inner.Find(base.Scale(qty));"),
        text("            return Math.Round(rate);"),
        F.when(key % 6 == 0, text("              }")).otherwise(text("        }")),
        text("        private static void Reset() => Clear();"),
        text("    }"),
        text("    public interface I", name, key, " : IPart"),
        text("    {"),
        text("        int Count(List<int> items);"),
        text("        string Title { get; }"),
        text("    }"),
        text("}"),
    ]
    newline = F.when(key % 2 == 0, F.lit("\n")).otherwise(F.lit("\r\n"))
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("project"),
        text("src/", key, ".cs").alias("path"),
        F.concat_ws("\u0003", *lines).alias("_text"),
        newline.alias("_newline"),
    ).select("project", "path", F.replace("_text", F.lit("\u0003"), F.col("_newline")).alias("content"))


# The same choices, and the lines that follow from them.
SOURCE_PARTS = f"""choices AS (
  SELECT p_type AS project, 'src/' || p_partkey || '.cs' AS path, p_partkey AS k, p_size, p_type, p_name,
         replace(p_brand, '#', '') AS brand, {PART_NAME} || p_partkey AS name, 'Price' || (p_partkey % 7) AS price,
         (9 - p_partkey % 2)::INTEGER AS fields_at, (p_partkey % 5)::INTEGER AS extra,
         CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE 0 END AS nested, CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 0 END AS spread
  FROM part),
src AS (
  SELECT *, inner_at + nested AS key_at, inner_at + nested + 3 AS http_at, inner_at + nested + 10 + spread AS reset_at,
         inner_at + nested + 12 + spread AS face_at
  FROM (SELECT *, fields_at + 2 + extra + 4 AS inner_at FROM choices) AS c)"""


# Manifests and member docs made from parts and suppliers ---------------------------


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project manifest per part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    framework = (
        F.when(size % 3 == 0, F.lit("<TargetFramework>net9.0</TargetFramework>"))
        .when(size % 3 == 1, F.lit("<TargetFrameworks>net8.0;net10.0</TargetFrameworks>"))
        .otherwise(F.lit(""))
    )
    reference = text('    <PackageReference Include="', F.col("p_name"), '" Version="', size, '.0.1" />\n')
    unversioned = text('    <PackageReference Include="', F.col("p_brand"), '"></PackageReference>\n')
    content = text(
        '<Project Sdk="Sdk.', F.col("p_type"), '">\n  <PropertyGroup>', framework, "</PropertyGroup>\n  <ItemGroup>\n",
        F.when(size % 2 == 0, reference).otherwise(F.lit("")),
        F.when(size % 5 == 0, unversioned).otherwise(F.lit("")),
        "  </ItemGroup>\n</Project>\n",
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("project"), text("m/", key, ".csproj").alias("path"), content.alias("content")
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One member documentation file per part."""
    key, brand = F.col("p_partkey"), F.replace("p_brand", F.lit("#"), F.lit(""))
    name = part_name()
    content = text(
        "<doc><members>\n<member name=\"T:", brand, ".", name, "\">\n<summary>\n  The <see cref=\"T:System.Task\"/> of\n  ",
        F.col("p_name"), " <c>x</c>.\n</summary>\n</member>\n",
        "<member name=\"M:", brand, ".", name, ".Run(System.Int32)\">\n<summary>Runs <paramref name=\"n\"/> times.</summary>",
        "<param name=\"n\">How &lt;often&gt;</param><returns> a  ", F.col("p_size"), "</returns>",
        "<exception cref=\"T:System.Error\">never</exception></member>\n",
        "<member name=\"P:", brand, ".", name, ".Empty\"><summary> </summary></member>\n</members></doc>",
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("package"),
        F.when(F.col("p_size") % 2 == 0, F.lit("latest")).otherwise(text(F.col("p_size"), ".0")).alias("version"),
        text(F.when(F.col("p_size") % 7 == 0, F.lit("ref/")).otherwise(F.lit("lib/")), key, ".xml").alias("path"),
        content.alias("content"),
    )
