"""Queries for access rules, file trees and file information."""

from pyspark.sql import functions as F

from lodeline.functions import policy as P
from lodeline.operators import inventory as I
from lodeline.operators import policy as A
from lodeline.plans import views as V
from lodeline.plans.registered import query


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w.lower()}'" for w in words)


KEY = r"lower(replace(path, '\', '/'))"
SEGMENTS = f"string_split({KEY}, '/')"
NAME = f"list_extract(string_split(replace(path, '\\', '/'), '/'), -1)"
EXT = rf"lower(regexp_extract({NAME}, '(\.[^.]+)$', 1))"
BASE = f"WITH {V.PAGES}, {V.TREE}"


def in_dirs_sql(dirs: list[str]) -> str:
    return f"list_has_any({SEGMENTS}, [{listed(dirs)}])"


def like_sql(pattern: str) -> str:
    """The glob as a LIKE pattern over the lower-cased name."""
    return f"lower({NAME}) LIKE '{pattern.lower().replace('*', '%')}'"


READ_RULES = (
    [f"WHEN {in_dirs_sql(P.BLOCKED_DIRS)} THEN 'blocked_dir'",
     f"WHEN lower({NAME}) IN ({listed(P.BLOCKED_NAMES)}) THEN 'blocked_name'"]
    + [f"WHEN {like_sql(p)} THEN 'blocked_pattern:{p}'" for p in P.BLOCKED_PATTERNS]
    + [f"WHEN {EXT} <> '' AND {EXT} NOT IN ({listed(P.ALLOWED_EXTENSIONS)}) THEN 'extension_not_allowed'"]
    + ["WHEN " + " OR ".join(f"contains(lower(path), '{w}')" for w in P.SENSITIVE_WORDS) + " THEN 'sensitive_keyword'"]
)


@query(
    "not_excluded_dir",
    f"{BASE} SELECT page_id, NOT {in_dirs_sql(P.SKELETON_DIRS)} AS kept FROM tree_v",
)
def not_excluded_dir(spark, d):
    return V.tree(spark, d).select("page_id", P.not_excluded_dir(F.col("path"), P.SKELETON_DIRS).alias("kept"))


@query(
    "blocked_file_names",
    f"{BASE} SELECT page_id, lower({NAME}) IN ({listed(P.BLOCKED_NAMES)}) AS blocked FROM tree_v",
)
def blocked_file_names(spark, d):
    return V.tree(spark, d).select("page_id", P.blocked_file_name(P.file_name(F.col("path"))).alias("blocked"))


@query(
    "glob_match",
    f"""{BASE} SELECT page_id, lower({NAME}) LIKE '%o%.cs' AS star, lower({NAME}) LIKE '_.private.cs' AS mark FROM tree_v""",
)
def glob_match(spark, d):
    name = P.file_name(F.col("path"))
    return V.tree(spark, d).select(
        "page_id", P.glob_match(name, "*O*.cs").alias("star"), P.glob_match(name, "?.private.cs").alias("mark")
    )


@query(
    "loose_glob",
    f"""{BASE} SELECT page_id, lower({NAME}) LIKE '%o%n%' AS parts, lower({NAME}) = 'x.cs' AS plain FROM tree_v""",
)
def loose_glob(spark, d):
    name = P.file_name(F.col("path"))
    return V.tree(spark, d).select(
        "page_id", P.loose_glob(name, "o*n").alias("parts"), P.loose_glob(name, "X.cs").alias("plain")
    )


@query(
    "allowed_extensions",
    f"""{BASE} SELECT page_id, {EXT} AS ext, {EXT} = '' OR {EXT} IN ({listed(P.ALLOWED_EXTENSIONS)}) AS allowed FROM tree_v""",
)
def allowed_extensions(spark, d):
    ext = P.extension(F.col("path"))
    return V.tree(spark, d).select("page_id", ext.alias("ext"), P.allowed_extension(ext).alias("allowed"))


@query(
    "sensitive_documents",
    f"""WITH {V.FILES} SELECT project, path,
      {' OR '.join(f"contains(lower(content), '{w}')" for w in P.SENSITIVE_WORDS)} AS sensitive FROM files_v""",
)
def sensitive_documents(spark, d):
    return V.files(spark, d).select("project", "path", P.sensitive_keyword(F.col("content")).alias("sensitive"))


@query(
    "access_verdict",
    f"{BASE}, r AS (SELECT page_id, path, CASE {' '.join(READ_RULES)} ELSE 'ok' END AS reason FROM tree_v) "
    "SELECT *, reason = 'ok' AS allowed FROM r",
)
def access_verdict(spark, d):
    return A.access_verdict(V.tree(spark, d).select("page_id", "path"))


INSIDE = f"NOT starts_with({KEY}, '../')"


@query(
    "write_verdict",
    f"""{BASE}, r AS (SELECT page_id, path, CASE WHEN NOT ({INSIDE}) THEN 'path_traversal'
        WHEN {in_dirs_sql(P.BLOCKED_DIRS)} THEN 'blocked_dir'
        {' '.join(f"WHEN {like_sql(p if '*' not in p else '*' + p + '*')} THEN 'blocked_pattern:{p}'" for p in P.BLOCKED_PATTERNS)}
        ELSE 'ok' END AS reason FROM tree_v)
    SELECT *, reason = 'ok' AS allowed FROM r""",
)
def write_verdict(spark, d):
    return A.write_verdict(V.tree(spark, d).select("page_id", "path"))


@query("inside_root", f"{BASE} SELECT page_id, {INSIDE} AS inside FROM tree_v")
def inside_root(spark, d):
    return V.tree(spark, d).select("page_id", P.inside_root(F.col("path")).alias("inside"))


@query("exclude_tests", rf"{BASE} SELECT page_id, path FROM tree_v WHERE NOT contains('/' || replace(path, '\', '/'), '/Tests/')")
def exclude_tests(spark, d):
    rooted = V.tree(spark, d).withColumn("rooted", F.concat(F.lit("/"), "path"))
    return A.exclude_tests(rooted, path="rooted").select("page_id", "path")


@query(
    "file_type_labels",
    f"""{BASE} SELECT page_id, CASE {EXT} {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in P.FILE_TYPES.items())}
      ELSE 'Unknown' END AS label FROM tree_v""",
)
def file_type_labels(spark, d):
    return V.tree(spark, d).select("page_id", P.file_type_label(P.extension(F.col("path"))).alias("label"))


@query(
    "valid_names",
    r"""WITH t AS (SELECT p_partkey, replace(p_brand, '#', CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '#' END) AS id,
        p_size || '.' || (p_partkey % 10) || CASE p_partkey % 3 WHEN 0 THEN '-rc.1' WHEN 1 THEN '' ELSE '.x' END AS version
      FROM part)
    SELECT p_partkey, p_partkey % 2 = 0 AS id_ok, p_partkey % 3 <> 2 AS version_ok FROM t""",
)
def valid_names(spark, d):
    key = F.col("p_partkey")
    package = F.replace("p_brand", F.lit("#"), F.when(key % 2 == 0, F.lit(".")).otherwise(F.lit("#")))
    tail = F.when(key % 3 == 0, F.lit("-rc.1")).when(key % 3 == 1, F.lit("")).otherwise(F.lit(".x"))
    version = V.text(F.col("p_size"), ".", key % 10, tail)
    return V.table(spark, d, "part").select(
        "p_partkey", P.valid_id(package).alias("id_ok"), P.valid_version(version).alias("version_ok")
    )


@query(
    "valid_paths",
    r"SELECT page_id, regexp_matches(url, '^[a-zA-Z0-9\\/:\\_\-\.\s]+$') AS path_ok FROM pages",
)
def valid_paths(spark, d):
    return V.table(spark, d, "pages").select("page_id", P.valid_path(F.col("url")).alias("path_ok"))


@query(
    "environment_checks",
    """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'name required' WHEN page_id % 7 = 1 THEN 'url required'
        WHEN page_id % 7 = 2 THEN 'url must be http or https' WHEN page_id % 7 = 3 THEN 'token required'
        WHEN page_id % 7 = 4 THEN 'username required' ELSE 'ok' END AS reason FROM pages""",
)
def environment_checks(spark, d):
    kind = F.col("page_id") % 7
    url = (
        F.when(kind == 1, F.lit(" "))
        .when(kind == 2, F.regexp_replace("url", "^https?:", "ftp:"))
        .otherwise(F.concat(F.lit(" "), "url"))
    )
    auth = F.when(kind == 3, F.lit("Bearer")).when(kind == 4, F.lit("Basic")).when(kind == 5, F.lit("Bearer")).otherwise(F.lit("None"))
    secret = F.when(kind == 5, F.lit("abc"))
    name = F.when(kind == 0, F.lit("")).otherwise(F.lit("env"))
    return V.table(spark, d, "pages").select(
        "page_id", F.coalesce(P.environment_reason(name, url, auth, secret), F.lit("ok")).alias("reason")
    )


# Inventory ------------------------------------------------------------------

FOLDER = r"regexp_extract(replace(path, '\', '/'), '^(.*)/[^/]*$', 1)"
# few folders, so that some are large
SHELF = """shelf_v AS (SELECT lang AS project, project || '/' || (doc_id % 3) || '/' || doc_id || '.txt' AS path,
  size_bytes, content, len(string_split(content, chr(10))) AS line_count FROM files_v)"""


def shelf(spark, d):
    key = F.col("doc_id")
    return V.files(spark, d).select(
        F.col("lang").alias("project"),
        V.text(F.col("project"), "/", key % 3, "/", key, ".txt").alias("path"),
        "size_bytes",
        "content",
        F.size(F.split("content", "\n")).alias("line_count"),
    )


@query(
    "collapse_large_folders",
    f"""WITH {V.FILES}, {SHELF}, f AS (SELECT project, {FOLDER} AS folder, path,
        count(*) OVER (PARTITION BY project, {FOLDER}) AS files FROM shelf_v)
    SELECT project, folder, path, files, false AS collapsed FROM f WHERE files <= 10
    UNION ALL SELECT DISTINCT project, folder, '', files, true FROM f WHERE files > 10""",
)
def collapse_large_folders(spark, d):
    return I.collapse_large_folders(shelf(spark, d), above=10)


@query(
    "folder_tree",
    f"""WITH {V.FILES}, {SHELF}, s AS (SELECT *, string_split({FOLDER}, '/') AS parts FROM shelf_v),
    x AS (SELECT project, array_to_string(parts[1:n], '/') AS folder, n AS depth, size_bytes, line_count
          FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS n FROM s) y),
    g AS (SELECT project, folder, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
      CAST(sum(line_count) AS BIGINT) AS line_count, count(*) FILTER (size_bytes > 15360) AS large_files,
      CAST(max(depth) AS INT) AS depth FROM x GROUP BY project, folder)
    SELECT *, replace(replace(CASE WHEN size_bytes < 1024 THEN printf('%.1f', size_bytes * 1.0::DOUBLE) || '|B'
      WHEN size_bytes < 1048576 THEN printf('%.1f', round(size_bytes / 1024.0, 1)) || '|KB'
      ELSE printf('%.1f', round(size_bytes / 1048576.0, 1)) || '|MB' END, '.0|', '|'), '|', '') AS size FROM g""",
)
def folder_tree(spark, d):
    return I.folder_tree(shelf(spark, d))


@query(
    "last_siblings",
    f"""WITH {V.FILES}, {SHELF} SELECT project, {FOLDER} AS folder, path,
      lead(path) OVER (PARTITION BY project, {FOLDER} ORDER BY path) IS NULL AS is_last FROM shelf_v""",
)
def last_siblings(spark, d):
    return I.last_siblings(shelf(spark, d))


@query(
    "folder_listing",
    f"""WITH {V.FILES}, {SHELF} SELECT project, path, {NAME} AS name FROM shelf_v
    WHERE {FOLDER} = 'src1/2' AND contains(lower({NAME}), '1')""",
)
def folder_listing(spark, d):
    return I.folder_listing(shelf(spark, d), "src1/2", " 1 ").select("project", "path", "name")


@query(
    "file_info",
    f"""WITH {V.FILES}, r AS (SELECT path FROM files_v UNION SELECT path || '.old' FROM files_v)
    SELECT r.path, f.path IS NOT NULL AS exists, coalesce(len(string_split(content, chr(10))), -1) AS line_count,
      coalesce(size_bytes, -1) AS size_bytes, CASE WHEN f.path IS NULL THEN '' ELSE '.txt' END AS ext, doc_id * 1000 AS modified
    FROM r LEFT JOIN files_v f ON f.path = r.path""",
)
def file_info(spark, d):
    files = V.files(spark, d)
    wanted = files.select("path").unionByName(files.select(V.text(F.col("path"), ".old").alias("path")))
    info = I.file_info(files.withColumn("modified_at", F.timestamp_seconds(F.col("doc_id") * 1000)), wanted)
    return info.withColumn("modified", F.unix_seconds("modified_at")).drop("modified_at")


@query(
    "enrich_results",
    f"""WITH {V.FILES}, r AS (SELECT upper(path) AS path, doc_id % 3 <> 0 AS success FROM files_v)
    SELECT r.path, r.success, coalesce(len(string_split(content, chr(10))), -1) AS line_count,
      coalesce(size_bytes, -1) AS size_bytes
    FROM r LEFT JOIN files_v f ON lower(r.path) = lower(f.path) AND r.success""",
)
def enrich_results(spark, d):
    files = V.files(spark, d)
    results = files.select(F.upper("path").alias("path"), (F.col("doc_id") % 3 != 0).alias("success"))
    return I.enrich_results(results, I.file_info(files, files)).select(
        "path", "success", F.coalesce("line_count", F.lit(-1)).alias("line_count"),
        F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"),
    )


@query(
    "deepest_first",
    f"{BASE} SELECT DISTINCT path, len(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p <> '')) AS depth FROM tree_v",
)
def deepest_first(spark, d):
    return I.deepest_first(V.tree(spark, d).select("path").distinct())


PROFILE = """proj_v AS (
  SELECT p_type || (p_partkey % 50) AS project, p_partkey,
    CASE p_size % 4 WHEN 0 THEN 'App' || p_partkey || '.sln' WHEN 1 THEN 'App' || p_partkey || '.slnx'
      WHEN 2 THEN 'src/App' || p_partkey || '.csproj' ELSE 'bin/App' || p_partkey || '.csproj' END AS path,
    CASE WHEN p_size % 3 = 0 THEN '' ELSE 'net' || (p_size % 3 + 7) || '.0' END AS fw FROM part)"""


def project_files(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    app = V.text("App", key)
    path = (
        F.when(size % 4 == 0, V.text(app, ".sln")).when(size % 4 == 1, V.text(app, ".slnx"))
        .when(size % 4 == 2, V.text("src/", app, ".csproj")).otherwise(V.text("bin/", app, ".csproj"))
    )
    framework = F.when(size % 3 == 0, F.lit("<p/>")).otherwise(
        V.text("<targetframework>net", size % 3 + 7, ".0</TargetFramework>")
    )
    return V.table(spark, d, "part").select(
        V.text(F.col("p_type"), key % 50).alias("project"), path.alias("path"), framework.alias("content")
    )


@query(
    "project_profile",
    f"""WITH {PROFILE}, g AS (SELECT project, bool_or(ends_with(path, '.sln') OR ends_with(path, '.slnx')) AS has_solution,
      count(*) FILTER (starts_with(path, 'src/')) AS manifests,
      coalesce(arg_min(fw, path) FILTER (starts_with(path, 'src/')), '-') AS framework FROM proj_v GROUP BY project)
    SELECT *, has_solution OR manifests > 0 AS is_valid FROM g""",
)
def project_profile(spark, d):
    return I.project_profile(project_files(spark, d)).withColumn("framework", F.coalesce("framework", F.lit("-")))


@query(
    "solution_files",
    f"""WITH {PROFILE} SELECT project, path, CASE WHEN ends_with(path, '.sln') THEN 0 ELSE 1 END AS rank
    FROM proj_v WHERE ends_with(path, '.sln') OR ends_with(path, '.slnx')""",
)
def solution_files(spark, d):
    return I.solution_files(project_files(spark, d))


@query(
    "target_frameworks",
    f"WITH {PROFILE} SELECT project, path, coalesce(nullif(fw, ''), '-') AS framework FROM proj_v",
)
def target_frameworks(spark, d):
    return project_files(spark, d).select(
        "project", "path", F.coalesce(I.target_framework(F.col("content")), F.lit("-")).alias("framework")
    )
