"""Queries over line patches and batches of file operations."""

from pyspark.sql import functions as F

from lodeline.operators import inventory as I
from lodeline.operators import patches as P
from lodeline.plans import views as V
from lodeline.plans.registered import query

BASE = f"WITH {V.FILES}, {V.LINES}, {V.PATCHES}"

CHECKED = """checked_v AS (
  SELECT p.*, CASE WHEN t.total IS NULL THEN 'file not found'
      WHEN action IN ('patch', 'delete') AND (start_line < 1 OR start_line > total) THEN 'start out of range'
      WHEN action IN ('patch', 'delete') AND end_line < start_line THEN 'end before start'
      WHEN action IN ('patch', 'delete') AND end_line > total THEN 'end out of range'
      WHEN action = 'insert' AND (start_line < 0 OR start_line > total) THEN 'start out of range'
      WHEN action IN ('patch', 'insert') AND content IS NULL THEN 'content required' ELSE 'ok' END AS reason
  FROM patches_v p LEFT JOIN (SELECT path, max(line_no) AS total FROM lines_v GROUP BY path) t ON t.path = p.path)"""

CONFLICTS = """conflicts_v AS (
  SELECT path, seq, next_seq FROM (
    SELECT path, seq, last, lead(seq) OVER w AS next_seq, lead(first) OVER w AS next_first FROM (
      SELECT path, seq, CASE action WHEN 'insert' THEN start_line + 1 ELSE start_line END AS first,
             CASE action WHEN 'insert' THEN start_line + 1 ELSE end_line END AS last
      FROM patches_v WHERE action <> 'append') x
    WINDOW w AS (PARTITION BY path ORDER BY first, seq)) y WHERE next_seq IS NOT NULL AND last >= next_first)"""

ACCEPTED = """accepted_v AS (
  SELECT * FROM patches_v WHERE path NOT IN (SELECT path FROM checked_v WHERE reason <> 'ok')
    AND path NOT IN (SELECT path FROM conflicts_v))"""


@query("validate_patches", f"{BASE}, {CHECKED} SELECT path, seq, action, reason FROM checked_v")
def validate_patches(spark, d):
    return P.validate_patches(V.patches(spark, d), V.files(spark, d)).select("path", "seq", "action", "reason")


@query("patch_conflicts", f"{BASE}, {CONFLICTS} SELECT path, seq, next_seq FROM conflicts_v")
def patch_conflicts(spark, d):
    return P.patch_conflicts(V.patches(spark, d)).select("path", "seq", "next_seq")


@query(
    "order_patch_conflicts",
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS first, l_linenumber + CAST(l_quantity AS INT) % 2 AS last,
        l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 100000000 AS seq FROM lineitem),
    n AS (SELECT *, lead(first) OVER (PARTITION BY k ORDER BY first, seq, last) AS next_first FROM s)
    SELECT 'o' || k AS path, seq, first, last FROM n WHERE last >= next_first""",
)
def order_patch_conflicts(spark, d):
    """Overlaps among as many patches as there are line items."""
    start = F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    patches = V.table(spark, d, "lineitem").select(
        V.text("o", F.col("l_orderkey")).alias("path"),
        (F.col("l_partkey") * 100000000 + cents % 100000000).alias("seq"),
        F.lit("patch").alias("action"),
        start.alias("start_line"),
        (start + F.col("l_quantity").cast("int") % 2).alias("end_line"),
    )
    return P.patch_conflicts(patches).select("path", "seq", "first", "last")


@query(
    "apply_patches",
    f"""{BASE}, {CHECKED}, {CONFLICTS}, {ACCEPTED},
    gone AS (SELECT path, start_line AS line_no FROM accepted_v WHERE action IN ('patch', 'delete')),
    rows AS (
      SELECT path, line_no AS at_line, 0 AS slot, 0 AS seq, 0 AS pos, line FROM lines_v
        WHERE path IN (SELECT path FROM accepted_v) AND (path, line_no) NOT IN (SELECT (path, line_no) FROM gone)
      UNION ALL SELECT path, CASE action WHEN 'append' THEN 2147483647 ELSE start_line END, CASE action WHEN 'insert' THEN 1 ELSE 0 END,
        seq, unnest(range(1, len(string_split(content, chr(10))) + 1)), unnest(string_split(content, chr(10)))
        FROM accepted_v WHERE action <> 'delete')
    SELECT path, row_number() OVER (PARTITION BY path ORDER BY at_line, slot, seq, pos) AS line_no, line FROM rows""",
)
def apply_patches(spark, d):
    files, patches = V.files(spark, d), V.patches(spark, d)
    return P.apply_patches(P.accepted_patches(patches, files), files)


@query(
    "lines_affected",
    f"""{BASE}, {CHECKED}, {CONFLICTS}, {ACCEPTED} SELECT path, count(*) AS patches, CAST(sum(CASE WHEN action IN ('patch', 'delete')
      THEN end_line - start_line + 1 ELSE len(string_split(content, chr(10))) END) AS BIGINT) AS lines_affected
    FROM accepted_v GROUP BY path""",
)
def lines_affected(spark, d):
    files, patches = V.files(spark, d), V.patches(spark, d)
    return P.lines_affected(P.accepted_patches(patches, files))


@query(
    "write_mode_check",
    """WITH r AS (SELECT doc_id, ['create', 'overwrite', 'upsert'][doc_id % 3 + 1] AS mode, doc_id IN (SELECT doc_id FROM labels) AS e FROM documents)
    SELECT 'd/' || doc_id AS path, mode, CASE WHEN mode = 'create' AND e THEN 'already exists'
      WHEN mode = 'overwrite' AND NOT e THEN 'does not exist' ELSE '' END AS error,
      NOT ((mode = 'create' AND e) OR (mode = 'overwrite' AND NOT e)) AS success FROM r""",
)
def write_mode_check(spark, d):
    name = V.text("d/", F.col("doc_id")).alias("path")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("create", "overwrite", "upsert")]), (F.col("doc_id") % 3 + 1).cast("int"))
    requests = V.table(spark, d, "documents").select(name, mode.alias("mode"))
    return P.write_mode_check(requests, V.table(spark, d, "labels").select(name)).select("path", "mode", "error", "success")


MOVES = """moves_v AS (
  SELECT 'c' || o_custkey AS batch, CASE WHEN o_orderkey % 11 = 0 THEN 'bin/' ELSE 'o/' END || o_orderkey AS source,
    'o/' || CASE o_orderstatus WHEN 'F' THEN o_orderkey + 100000000 WHEN 'O' THEN o_orderkey + 200000000 ELSE o_orderkey + 1 END AS target
  FROM orders)"""


@query(
    "plan_moves",
    f"""WITH {MOVES}, f AS (SELECT DISTINCT 'o/' || l_orderkey AS path FROM lineitem),
    e AS (SELECT *, CASE WHEN starts_with(source, 'bin/') THEN 'blocked_dir'
        WHEN source NOT IN (SELECT path FROM f) THEN 'source not found'
        WHEN target IN (SELECT path FROM f) THEN 'target exists' ELSE '' END AS error FROM moves_v)
    SELECT batch, source, target, error, bool_and(error = '') OVER (PARTITION BY batch) AS executed FROM e""",
)
def plan_moves(spark, d):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    folder = F.when(key % 11 == 0, F.lit("bin/")).otherwise(F.lit("o/"))
    number = F.when(status == "F", key + 100000000).when(status == "O", key + 200000000).otherwise(key + 1)
    moves = V.table(spark, d, "orders").select(
        V.text("c", F.col("o_custkey")).alias("batch"),
        V.text(folder, key).alias("source"),
        V.text("o/", number).alias("target"),
    )
    files = V.table(spark, d, "lineitem").select(V.text("o/", F.col("l_orderkey")).alias("path"))
    return P.plan_moves(moves, files).select("batch", "source", "target", "error", "executed")


@query(
    "all_or_nothing",
    """SELECT o_orderkey, o_custkey, bool_and(o_totalprice < 450000) OVER (PARTITION BY o_custkey) AS batch_ok FROM orders""",
)
def all_or_nothing(spark, d):
    orders = V.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") < 450000).alias("valid")
    )
    return P.all_or_nothing(orders, "valid", "o_custkey").select("o_orderkey", "o_custkey", "batch_ok")


@query(
    "plan_deletes",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'logs/' ELSE 'd/' END || doc_id AS path, doc_id % 2 = 0 AS is_folder,
        doc_id IN (SELECT doc_id FROM labels) AS e FROM documents), x AS (
    SELECT path, is_folder, CASE WHEN starts_with(path, 'logs/') THEN 'blocked_dir'
      WHEN NOT is_folder AND NOT e THEN 'file not found' ELSE '' END AS error FROM r)
    SELECT *, error = '' AS success FROM x""",
)
def plan_deletes(spark, d):
    key = F.col("doc_id")
    folder = F.when(key % 7 == 0, F.lit("logs/")).otherwise(F.lit("d/"))
    requests = V.table(spark, d, "documents").select(V.text(folder, key).alias("path"), (key % 2 == 0).alias("is_folder"))
    files = V.table(spark, d, "labels").select(V.text("d/", key).alias("path"))
    return P.plan_deletes(requests, files).select("path", "is_folder", "error", "success")


@query(
    "batch_outcome",
    """SELECT user_id, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
      CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS lines_affected
    FROM events GROUP BY user_id""",
)
def batch_outcome(spark, d):
    rows = V.table(spark, d, "events").select(
        "user_id", (F.col("event_type") != "error").alias("success"), F.floor("value").cast("bigint").alias("lines_affected")
    )
    return P.batch_outcome(rows, "user_id")


@query(
    "folder_members",
    f"""WITH {V.FILES}, w AS (SELECT DISTINCT upper(lang) AS folder FROM files_v)
    SELECT folder, path FROM files_v JOIN w ON starts_with(lower(path), lower(folder) || '/')""",
)
def folder_members(spark, d):
    files = V.files(spark, d)
    return P.folder_members(files, files.select(F.upper("lang").alias("folder")).distinct())


@query(
    "folders_to_delete",
    f"""WITH {V.PAGES} SELECT DISTINCT path AS folder, len(list_filter(string_split(path, '/'), lambda p: p <> '')) AS depth FROM pages_v""",
)
def folders_to_delete(spark, d):
    folders = V.pages(spark, d).select(F.col("path").alias("folder")).distinct()
    return I.deepest_first(folders, "folder")


@query(
    "first_per_key",
    """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
def first_per_key(spark, d):
    from lodeline.streaming.changes import latest_per_key

    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (-F.col("l_partkey")).alias("age"))
    return latest_per_key(rows, ["l_orderkey", "l_linenumber"], ["age"]).drop("age")
