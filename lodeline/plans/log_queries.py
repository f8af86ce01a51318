"""Queries over compiler logs and response payloads."""

from pyspark.sql import functions as F

from lodeline.functions import expiry as E
from lodeline.functions import naming as N
from lodeline.functions import payload as PL
from lodeline.functions.text import epoch_micros
from lodeline.operators import logs as L
from lodeline.operators.ordered import page_diagnostics as diagnostics_page
from lodeline.plans import views as V
from lodeline.plans.registered import query

BASE = f"WITH {V.DIAGNOSTICS}"


def diagnostics(spark, d):
    return L.parse_diagnostics(V.log(spark, d), "build", "seq", "l_suppkey", "l_partkey", "l_extendedprice", line="line")


@query(
    "parse_diagnostics",
    f"{BASE} SELECT build, seq, severity, code, file, line, col, message, count(*) AS times FROM diag_v GROUP BY ALL",
)
def parse_diagnostics(spark, d):
    columns = ["build", "seq", "severity", "code", "file", "line", "col", "message"]
    return diagnostics(spark, d).groupBy(*columns).agg(F.count("*").alias("times"))


FIRST = """first_v AS (SELECT file, line, code, arg_min(severity, (build, seq, l_suppkey, l_partkey, l_extendedprice)) AS severity,
  arg_min(message, (build, seq, l_suppkey, l_partkey, l_extendedprice)) AS message,
  min(build) AS build FROM diag_v GROUP BY file, line, code)"""


def deduped(spark, d):
    return L.dedupe_diagnostics(diagnostics(spark, d), "build", "seq", "l_suppkey", "l_partkey", "l_extendedprice")


@query("dedupe_diagnostics", f"{BASE}, {FIRST} SELECT file, line, code, severity, message, build FROM first_v")
def dedupe_diagnostics(spark, d):
    return deduped(spark, d).select("file", "line", "code", "severity", "message", "build")


@query("severity_filter", f"{BASE} SELECT build, file, line, code FROM diag_v WHERE severity = 'error'")
def severity_filter(spark, d):
    return L.severity_filter(diagnostics(spark, d)).select("build", "file", "line", "code")


@query(
    "build_summary",
    f"""{BASE}, s AS (SELECT build, count(*) FILTER (severity = 'error') AS errors,
      count(*) FILTER (severity = 'warning') AS warnings FROM diag_v GROUP BY build)
    SELECT *, errors = 0 AS success, CASE WHEN errors = 0 THEN 'Build succeeded — 0 errors, ' || warnings || ' warning(s)'
      ELSE 'Build FAILED — ' || errors || ' error(s), ' || warnings || ' warning(s)' END AS summary FROM s""",
)
def build_summary(spark, d):
    return L.build_summary(diagnostics(spark, d), "build")


@query(
    "page_diagnostics",
    f"""{BASE}, {FIRST}, e AS (SELECT * FROM first_v WHERE severity = 'error'), n AS (SELECT count(*) AS total FROM e)
    SELECT file, line, code, 2 AS page, CAST(greatest(1, ceil(total / 200.0)) AS INT) AS total_pages, total AS total_diagnostics
    FROM e, n ORDER BY file, line, code LIMIT 200 OFFSET 200""",
)
def page_diagnostics(spark, d):
    errors = L.severity_filter(deduped(spark, d)).select("file", "line", "code")
    return diagnostics_page(errors, [F.asc("file"), F.asc("line"), F.asc("code")], page=2, size=1000)


PACKAGE_LOGS = """plog_v AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || ' Error: no such package ' || chr(10) || 'WARN: old index'
    WHEN 1 THEN text || chr(10) || 'unrecognized option' ELSE text END AS output FROM documents)"""


def package_logs(spark, d):
    key = F.col("doc_id")
    return V.table(spark, d, "documents").select(
        "doc_id",
        F.when(key % 3 == 0, F.concat("text", F.lit("\n Error: no such package \nWARN: old index")))
        .when(key % 3 == 1, F.concat("text", F.lit("\nunrecognized option")))
        .otherwise(F.col("text")).alias("output"),
    )


OK = "NOT (contains(lower(output), 'error') OR contains(lower(output), 'unrecognized'))"


@query("package_log_verdicts", f"WITH {PACKAGE_LOGS} SELECT doc_id, {OK} AS success FROM plog_v")
def package_log_verdicts(spark, d):
    return package_logs(spark, d).select("doc_id", L.package_log_ok(F.col("output")).alias("success"))


@query(
    "parse_package_logs",
    f"""WITH {PACKAGE_LOGS}, l AS (SELECT doc_id, unnest(range(1, len(string_split(output, chr(10))) + 1)) AS line_no,
        unnest(string_split(output, chr(10))) AS raw FROM plog_v WHERE NOT ({OK}))
    SELECT doc_id, line_no, trim(raw) AS message, CASE WHEN contains(lower(raw), 'error') THEN 'error' ELSE 'warning' END AS severity
    FROM l WHERE contains(lower(raw), 'error') OR contains(lower(raw), 'warn')""",
)
def parse_package_logs(spark, d):
    return L.parse_package_log(package_logs(spark, d), "doc_id")


# Payloads -------------------------------------------------------------------


def payloads(spark, d):
    """Documents as bodies of every shape."""
    key, text = F.col("doc_id") % 6, F.col("text")
    lines = F.split(text, "\n")
    body = (
        F.when(key == 0, F.to_json(lines))
        .when(key == 1, F.to_json(F.struct("doc_id", "lang", text.alias("text"))))
        .when(key == 2, text)
        .when(key == 3, F.lit(""))
        .when(key == 4, F.concat(F.lit("{"), text))
        .otherwise(text)
    )
    kind = (
        F.when(key.isin(0, 1, 4), F.lit("application/json; charset=utf-8"))
        .when(key == 5, F.lit("image/png"))
        .otherwise(F.lit("text/plain"))
    )
    return V.table(spark, d, "documents").select("doc_id", kind.alias("content_type"), body.alias("body"))


SHAPES = "['array', 'object', 'text', 'empty', 'text', 'binary'][doc_id % 6 + 1]"


@query("payload_shapes", f"SELECT doc_id, {SHAPES} AS shape FROM documents")
def payload_shapes(spark, d):
    return payloads(spark, d).select("doc_id", PL.payload_shape(F.col("content_type"), F.col("body")).alias("shape"))


@query(
    "payload_stats",
    f"""WITH p AS (SELECT *, doc_id % 6 AS k, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT doc_id, {SHAPES} AS shape, CASE WHEN k = 0 THEN n ELSE -1 END AS array_count,
      CASE WHEN k = 1 THEN 'doc_id,lang,text' ELSE '' END AS top_level_keys,
      CASE WHEN k IN (2, 4) THEN n ELSE -1 END AS line_count,
      CASE WHEN k IN (0, 2) THEN least(n, 5) ELSE -1 END AS shown FROM p""",
)
def payload_stats(spark, d):
    stats = PL.payload_stats(F.col("content_type"), F.col("body"), 32768, 5)
    return payloads(spark, d).select("doc_id", *[c.alias(n) for n, c in stats.items() if n != "truncated"])


@query(
    "payload_truncation",
    """WITH p AS (SELECT doc_id, doc_id % 6 AS k, strlen(text) AS n, len(string_split(text, chr(10))) AS items,
        strlen(CAST(to_json(string_split(text, chr(10))) AS VARCHAR)) AS list_bytes,
        strlen(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'text': text}) AS VARCHAR)) AS object_bytes FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN list_bytes > 1024 OR items > 5 WHEN 1 THEN object_bytes > 1024 WHEN 2 THEN n > 1024
      WHEN 3 THEN false WHEN 4 THEN n + 1 > 1024 ELSE true END AS truncated FROM p""",
)
def payload_truncation(spark, d):
    stats = PL.payload_stats(F.col("content_type"), F.col("body"), 1024, 5)
    return payloads(spark, d).select("doc_id", stats["truncated"].alias("truncated"))


@query(
    "preview_items",
    """SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS items FROM documents WHERE doc_id % 6 = 0""",
)
def preview_items(spark, d):
    items = PL.preview_items(F.col("body"), 2)
    plain = F.transform(items, lambda i: F.get_json_object(F.concat(F.lit('{"v":'), i, F.lit("}")), "$.v"))
    arrays = payloads(spark, d).where(PL.json_kind(F.col("body")) == "array")
    return arrays.select("doc_id", F.array_join(plain, "\n").alias("items"))


@query(
    "event_payloads",
    """SELECT event_id, 'object' AS shape, 'k' AS top_level_keys, 1 AS line_count, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events""",
)
def event_payloads(spark, d):
    json = F.lit("application/json")
    stats = PL.payload_stats(json, F.col("props"), 1024, 5)
    return V.table(spark, d, "events").select(
        "event_id", stats["shape"].alias("shape"), stats["top_level_keys"].alias("top_level_keys"),
        F.lit(1).alias("line_count"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


@query(
    "allowlist_headers",
    """SELECT event_id, 'Content-Type=' || event_type || CASE WHEN event_id % 2 = 0 THEN ';ETAG=' || user_id ELSE '' END AS headers FROM events""",
)
def allowlist_headers(spark, d):
    headers = F.create_map(
        F.lit("Content-Type"), F.col("event_type"),
        F.when(F.col("event_id") % 2 == 0, F.lit("ETAG")).otherwise(F.lit("Set-Cookie")), F.col("user_id").cast("string"),
        F.lit("Authorization"), F.lit("abc"),
    )
    kept = F.map_entries(PL.allowlist_map(headers))
    shown = F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return V.table(spark, d, "events").select("event_id", shown.alias("headers"))


# Remaining life ---------------------------------------------------------------

# seven days from the event, seen from the middle of the month
NOW_MS = 1705363200000
LEFT = f"(epoch_ms(ts) + 604800000 - {NOW_MS})"


def ms_left():
    return F.floor(epoch_micros(F.col("ts")) / 1000).cast("bigint") + 604800000 - F.lit(NOW_MS)


@query(
    "ttl_labels",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE {LEFT} END AS ms FROM events)
    SELECT event_id, CASE WHEN ms IS NULL THEN 'none' WHEN ms < 21600000 THEN 'red' WHEN ms < 172800000 THEN 'orange' ELSE 'green' END AS class,
      CASE WHEN ms IS NULL THEN 'No expiry' WHEN ms <= 0 THEN 'Expired'
        WHEN ms >= 86400000 THEN (ms // 86400000) || 'd ' || (ms % 86400000 // 3600000) || 'h'
        WHEN ms >= 3600000 THEN (ms // 3600000) || 'h ' || (ms % 3600000 // 60000) || 'm'
        ELSE (ms // 60000) || 'm' END AS left_text FROM e""",
)
def ttl_labels(spark, d):
    left = F.when(F.col("event_type") != "error", ms_left())
    return V.table(spark, d, "events").select("event_id", left.alias("ms")).select(
        "event_id", E.ttl_class(F.col("ms")).alias("class"), E.format_ttl(F.col("ms")).alias("left_text")
    )


@query(
    "expiring_counts",
    f"""SELECT event_type, count(*) AS entries, count(*) FILTER ({LEFT} >= 0 AND {LEFT} < 21600000) AS expiring
    FROM events GROUP BY event_type""",
)
def expiring_counts(spark, d):
    return V.table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("entries"), F.count_if(E.expires_soon(ms_left())).alias("expiring")
    )


@query(
    "line_labels",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 AND CAST(l_quantity AS INT) % 2 = 0 THEN '// Line 1'
        WHEN CAST(l_quantity AS INT) % 2 = 0 THEN '// Line ' || l_linenumber
        ELSE '// Lines ' || l_linenumber || '-' || (l_linenumber + 1) END AS label,
      concat_ws(' ', CASE WHEN l_returnflag <> 'R' THEN 'get;' END, CASE WHEN l_linestatus = 'F' THEN 'set;' END) AS accessors
    FROM lineitem""",
)
def line_labels(spark, d):
    start = F.col("l_linenumber")
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.line_label(start, start + F.col("l_quantity").cast("int") % 2).alias("label"),
        N.accessor_string(F.col("l_returnflag") != "R", F.col("l_linestatus") == "F").alias("accessors"),
    )
