"""Queries over documents as files: lines, sizes, markers, cutoffs, previews."""

from pyspark.sql import functions as F

from lodeline.functions import payload as PL
from lodeline.functions import text as X
from lodeline.operators import lines as L
from lodeline.operators.ordered import page_clamped
from lodeline.operators.policy import changed_since, project_filter
from lodeline.plans import views as V
from lodeline.plans.registered import query

GREP = "tion"


@query(
    "read_files",
    f"WITH {V.FILES} SELECT project, path, size_bytes, length(content) AS n_chars, md5(content) AS digest FROM files_v",
)
def read_files(spark, d):
    return V.files(spark, d).select(
        "project", "path", "size_bytes", F.length("content").cast("bigint").alias("n_chars"),
        F.md5(F.encode("content", "UTF-8")).alias("digest"),
    )


@query("explode_lines", f"WITH {V.FILES}, {V.LINES} SELECT project, path, line_no, line FROM lines_v")
def explode_lines(spark, d):
    return L.explode_lines(V.files(spark, d), "project", "path")


@query(
    "grep_documents",
    f"""WITH {V.FILES}, {V.LINES}
    SELECT project, path, line_no, line, printf('%4d | %s', line_no, line) AS shown
    FROM lines_v WHERE contains(lower(line), '{GREP}')""",
)
def grep_documents(spark, d):
    return L.grep(V.files(spark, d), GREP, "project", "path")


GREP_COUNTS = f"""SELECT project, path,
      len(list_filter(string_split(content, chr(10)), lambda l: contains(lower(l), '{GREP}'))) AS match_count,
      len(string_split(content, chr(10))) AS total_lines
    FROM files_v WHERE contains(lower(content), '{GREP}')"""


@query("grep_counts", f"WITH {V.FILES} {GREP_COUNTS}")
def grep_counts(spark, d):
    return L.grep_counts(V.files(spark, d), GREP, "project", "path")


@query(
    "grep_ranked_page",
    f"""WITH {V.FILES}, hits AS ({GREP_COUNTS}), n AS (SELECT count(*) AS total FROM hits)
    SELECT project, path, match_count, total_lines, 2 AS page,
           CAST(ceil(total / 20.0) AS INT) AS total_pages, total AS total_results
    FROM hits, n ORDER BY match_count DESC, project, path LIMIT 20 OFFSET 20""",
)
def grep_ranked_page(spark, d):
    """Grep all documents, rank files by hits, show the second page."""
    hits = L.grep_counts(V.files(spark, d), GREP, "project", "path")
    return page_clamped(hits, [F.desc("match_count"), F.asc("project"), F.asc("path")], page=2, size=20)


@query(
    "line_range",
    f"""WITH {V.FILES}, {V.LINES}, t AS (SELECT project, path, max(line_no) AS total_lines FROM lines_v GROUP BY ALL)
    SELECT project, path, total_lines, least(9, total_lines) AS end_line, line_no, line
    FROM lines_v JOIN t USING (project, path) WHERE line_no BETWEEN 3 AND 9""",
)
def line_range(spark, d):
    return L.line_range(V.files(spark, d), 3, 9, "project", "path")


@query(
    "number_lines",
    f"WITH {V.FILES}, {V.LINES} SELECT project, path, line_no, printf('%4d | %s', line_no, line) AS shown FROM lines_v",
)
def number_lines(spark, d):
    return L.number_lines(V.files(spark, d), "project", "path")


@query(
    "slice_bodies",
    f"""WITH {V.BODIES}, s AS (SELECT *, string_split(full_code, chr(10)) AS ls FROM bodies_v)
    SELECT project, path, method_name, array_to_string(ls[2:4], chr(10)) AS full_code FROM s""",
)
def slice_bodies(spark, d):
    parts = L.slice_body(F.col("full_code"), F.lit(2), F.lit(4))
    return V.bodies(spark, d).select("project", "path", "method_name", parts["full_code"].alias("full_code"))


@query(
    "file_sizes",
    f"""WITH {V.FILES}, s AS (SELECT project, path, size_bytes,
      CASE WHEN size_bytes < 1024 THEN printf('%.1f', CAST(size_bytes AS DOUBLE)) || '|B'
           WHEN size_bytes < 1048576 THEN printf('%.1f', round(size_bytes / 1024.0, 1)) || '|KB'
           WHEN size_bytes < 1073741824 THEN printf('%.1f', round(size_bytes / 1048576.0, 1)) || '|MB'
           ELSE printf('%.1f', round(size_bytes / 1073741824.0, 1)) || '|GB' END AS raw FROM files_v)
    SELECT project, path, replace(replace(raw, '.0|', '|'), '|', '') AS size, size_bytes > 15360 AS is_large FROM s""",
)
def file_sizes(spark, d):
    return V.files(spark, d).select(
        "project", "path", X.format_size(F.col("size_bytes")).alias("size"),
        X.is_large(F.col("content")).alias("is_large"),
    )


@query(
    "line_counts",
    f"""WITH {V.FILES} SELECT project, path, len(string_split(content, chr(10))) AS split_lines,
      CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10)))
           - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS read_lines FROM files_v""",
)
def line_counts(spark, d):
    return V.files(spark, d).select(
        "project", "path",
        X.split_line_count(F.col("content")).alias("split_lines"),
        X.read_line_count(F.col("content")).alias("read_lines"),
    )


# By their key, files hold a type, top-level statements, registrations, a server, routes or settings.
MARKED = {
    0: "public class {} {{ }}", 1: "var {} = 1; app.UseRouting();", 2: "services.AddScoped<{}>(); await Run();",
    3: "interface {} {{ }} builder.Services.AddMcpServer().WithTools();", 4: '[Route("{}")] record Item;', 5: "// {}",
    6: '{{ "ConnectionStrings": "{}", "Logging": 1 }}', 7: '{{ "Logging": "{}" }}',
}
MARKED_SQL = "SELECT 'f/' || p_partkey AS path, CASE WHEN p_partkey % 8 > 5 THEN '.json' ELSE '.cs' END AS ext, CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN " + " || p_name || ".join(f"'{part}'" for part in text.replace("{{", "\1").replace("}}", "\2").split("{}")).replace("\1", "{").replace("\2", "}")
    for i, text in MARKED.items()
) + " END AS content FROM part"


def _marker_sql() -> str:
    """The markers of each file, searched for in its text."""
    has = lambda words: "(" + " OR ".join(f"contains(content, '{w}')" for w in words) + ")"
    shown = lambda test, label: f"CASE WHEN {test} THEN '{label}' END"
    labels = [
        shown("top_level", X.TOP_LEVEL_LABEL), shown("registers_services", X.REGISTRATION_LABEL), shown("configures_server", X.SERVER_LABEL),
        *[shown(f"ext = '.cs' AND contains(content, '{w}')", label) for w, label in X.SOURCE_LABELS.items()],
        *[shown(f"ext = '.json' AND contains(content, '{w}')", label) for w, label in X.CONFIG_LABELS.items()],
    ]
    return f"""WITH t AS ({MARKED_SQL}), m AS (
      SELECT *, ext = '.cs' AND {has(X.TYPE_MARKERS)} AS has_types,
        ext = '.cs' AND NOT {has(X.TYPE_MARKERS)} AND {has(X.TOP_LEVEL_MARKERS)} AS top_level,
        ext = '.cs' AND {has(X.REGISTRATION_MARKERS)} AS registers_services, ext = '.cs' AND {has(X.SERVER_MARKERS)} AS configures_server,
        ext = '.json' AS is_configuration FROM t)
    SELECT path, has_types, top_level, registers_services, configures_server, is_configuration, concat_ws('; ', {', '.join(labels)}) AS patterns FROM m"""


@query("content_markers", _marker_sql())
def content_markers(spark, d):
    key = F.col("p_partkey")
    content = F.lit(None).cast("string")
    for i, shape in MARKED.items():
        before, after = shape.replace("{{", "\1").replace("}}", "\2").split("{}")
        back = lambda t: t.replace("\1", "{").replace("\2", "}")
        content = F.when(key % 8 == i, V.text(back(before), F.col("p_name"), back(after))).otherwise(content)
    files = V.table(spark, d, "part").select(
        V.text("f/", key).alias("path"), F.when(key % 8 > 5, ".json").otherwise(".cs").alias("ext"), content.alias("content")
    )
    marks = X.content_markers(F.col("content"), F.col("ext"))
    return files.select("path", *[c.alias(n) for n, c in marks.items()])


@query(
    "truncate_bodies",
    f"""WITH {V.FILES} SELECT project, path, strlen(content) > 512 AS truncated,
      md5(CASE WHEN strlen(content) > 512 THEN left(content, (SELECT max(n) FROM range(128, 513) AS r(n) WHERE strlen(left(content, n)) <= 512)) ELSE content END) AS digest FROM files_v""",
)
def truncate_bodies(spark, d):
    body, over = X.truncate_body(F.col("content"), 512)
    return V.files(spark, d).select(
        "project", "path", over.alias("truncated"), F.md5(F.encode(body, "UTF-8")).alias("digest")
    )


@query(
    "preview_lines",
    f"""WITH {V.FILES} SELECT project, path, array_to_string(string_split(content, chr(10))[1:3], chr(10)) AS preview
    FROM files_v""",
)
def preview_lines(spark, d):
    return V.files(spark, d).select("project", "path", PL.preview_lines(F.col("content"), 3).alias("preview"))


@query(
    "project_filter",
    f"WITH {V.FILES} SELECT project, path, size_bytes FROM files_v WHERE project = 'src3'",
)
def one_project(spark, d):
    return project_filter(V.files(spark, d), "src3").select("project", "path", "size_bytes")


@query(
    "changed_since",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01 00:00:00'",
)
def changed_orders(spark, d):
    orders = V.table(spark, d, "orders")
    return changed_since(orders, "1998-06-01T00:00:00Z", "o_orderdate").select("o_orderkey", "o_custkey")


@query(
    "parse_cutoffs",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'unreadable'
         ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS cutoff FROM orders""",
)
def parse_cutoffs(spark, d):
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 3 == 0, F.floor(X.epoch_micros(date) / 1000000).cast("string"))
        .when(key % 3 == 1, F.concat(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .otherwise(F.lit("soon"))
    )
    # the instant is shown in UTC whatever the zone of the session is
    shown = F.to_utc_timestamp(X.parse_cutoff(F.col("text")), F.current_timezone())
    return V.table(spark, d, "orders").select("o_orderkey", text.alias("text")).select(
        "o_orderkey", F.coalesce(F.date_format(shown, "yyyy-MM-dd HH:mm:ss"), F.lit("unreadable")).alias("cutoff")
    )


@query(
    "to_zone",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc_time,
         strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS zone_time,
         CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS unix_seconds FROM events""",
)
def to_zone(spark, d):
    shown = X.to_zone(F.col("ts"), "Asia/Tokyo")
    return V.table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in shown.items()])
