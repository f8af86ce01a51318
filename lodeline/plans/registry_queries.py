"""Queries over projects and their environments."""

from pyspark.sql import functions as F

from lodeline.operators import registry as R
from lodeline.operators.policy import enabled_only as only_enabled
from lodeline.plans import views as V
from lodeline.plans.registered import query

PROJECTS = """projects_v AS (
  SELECT n_nationkey AS id, n_name AS name, n_regionkey <> 1 AS enabled FROM nation)"""


def projects(spark, d):
    return V.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 1).alias("enabled")
    )


ENVIRONMENTS = """env_v AS (
  SELECT c_nationkey AS project_id, c_name AS name, c_acctbal < -500 AS is_default, c_custkey AS seq,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Bearer' WHEN 'MACHINERY' THEN 'Basic' ELSE 'None' END AS auth_type FROM customer)"""


def environments(spark, d):
    segment = F.col("c_mktsegment")
    return V.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("project_id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") < -500).alias("is_default"),
        F.col("c_custkey").alias("seq"),
        F.when(segment == "BUILDING", "Bearer").when(segment == "MACHINERY", "Basic").otherwise("None").alias("auth_type"),
    )


@query("load_registry", f"WITH {PROJECTS} SELECT * FROM projects_v WHERE enabled")
def load_registry(spark, d):
    return R.load_registry(projects(spark, d))


@query(
    "enabled_only",
    f"""WITH {PROJECTS} SELECT s_suppkey, 'NATION_' || s_nationkey AS project FROM supplier
    WHERE 'NATION_' || s_nationkey IN (SELECT name FROM projects_v WHERE enabled)""",
)
def enabled_only(spark, d):
    rows = V.table(spark, d, "supplier").select("s_suppkey", V.text("NATION_", F.col("s_nationkey")).alias("project"))
    return only_enabled(rows, projects(spark, d)).select("s_suppkey", "project")


@query(
    "registry_semi",
    f"""WITH {PROJECTS} SELECT c_custkey, c_nationkey AS id FROM customer WHERE c_nationkey IN (SELECT id FROM projects_v WHERE enabled)""",
)
def registry_semi(spark, d):
    rows = V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    return R.registry_semi(rows, projects(spark, d), "id").select("c_custkey", "id")


REQUESTS = """req_v AS (
  SELECT c_custkey + 1000 AS id, CASE WHEN c_custkey % 3 = 0 THEN 'nation_' || (c_custkey % 25) ELSE 'New' || (c_custkey // 2) END AS name,
    true AS enabled, c_custkey AS seq FROM customer)"""


@query(
    "registry_add",
    f"""WITH {PROJECTS}, {REQUESTS}, have AS (SELECT * FROM projects_v WHERE id < 4),
    fresh AS (SELECT arg_min(id, seq) AS id, arg_min(name, seq) AS name, true AS enabled, min(seq) AS seq FROM req_v
      WHERE lower(name) NOT IN (SELECT lower(name) FROM have) GROUP BY lower(name))
    SELECT id, name, enabled FROM have UNION ALL (SELECT id, name, enabled FROM fresh ORDER BY seq LIMIT 6)""",
)
def registry_add(spark, d):
    return R.registry_add(*asked(spark, d))


def asked(spark, d):
    key = F.col("c_custkey")
    requests = V.table(spark, d, "customer").select(
        (key + 1000).alias("id"),
        F.when(key % 3 == 0, V.text("nation_", key % 25)).otherwise(V.text("New", F.floor(key / 2))).alias("name"),
        F.lit(True).alias("enabled"),
        key.alias("seq"),
    )
    return projects(spark, d).withColumn("id", F.col("id").cast("bigint")).where("id < 4"), requests


@query(
    "add_requests",
    f"""WITH {PROJECTS}, {REQUESTS}, have AS (SELECT lower(name) AS key FROM projects_v WHERE id < 4),
    ranked AS (SELECT *, lower(name) IN (SELECT key FROM have) AS taken, seq = min(seq) OVER (PARTITION BY lower(name)) AS first FROM req_v),
    placed AS (SELECT *, sum(CASE WHEN first AND NOT taken THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS place FROM ranked)
    SELECT id, name, seq, CASE WHEN taken THEN 'name taken' WHEN NOT first THEN 'asked before' WHEN place > 6 THEN 'registry full'
      ELSE 'added' END AS outcome FROM placed""",
)
def add_requests(spark, d):
    return R.add_requests(*asked(spark, d)).select("id", "name", "seq", "outcome")


@query(
    "registry_update",
    f"""WITH {PROJECTS} SELECT id, CASE WHEN id % 3 = 0 THEN 'Renamed' || id WHEN id % 3 = 1 THEN name ELSE upper(name) END AS name,
      CASE WHEN id % 3 = 1 THEN enabled ELSE true END AS enabled FROM projects_v""",
)
def registry_update(spark, d):
    """A third takes a new name, a third another project's name, a third its own in capitals."""
    have = projects(spark, d)
    key = F.col("id")
    updates = have.select(
        "id",
        F.when(key % 3 == 0, V.text("Renamed", key)).when(key % 3 == 1, V.text("NATION_", (key + 1) % 25))
        .otherwise(F.upper("name")).alias("name"),
        F.lit(True).alias("enabled"),
    )
    return R.registry_update(have, updates)


DEFAULT = """def_v AS (SELECT project_id, arg_min(name, (NOT is_default, seq)) AS environment,
  arg_min(seq, (NOT is_default, seq)) AS seq FROM env_v GROUP BY project_id)"""


@query("default_environments", f"WITH {ENVIRONMENTS}, {DEFAULT} SELECT * FROM def_v")
def default_environments(spark, d):
    return R.default_environment(environments(spark, d))


@query(
    "named_environments",
    f"""WITH {ENVIRONMENTS}, {DEFAULT} SELECT s_suppkey, project_id, environment AS name FROM supplier JOIN def_v ON project_id = s_nationkey
      WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, project_id, name FROM supplier JOIN env_v ON project_id = s_nationkey AND name = 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
      WHERE s_suppkey % 2 = 1""",
)
def named_environments(spark, d):
    key = F.col("s_suppkey")
    asked = F.when(key % 2 == 1, F.concat(F.lit("CUSTOMER#"), F.lpad(key.cast("string"), 9, "0")))
    requests = V.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("project_id"), asked.alias("environment"))
    keyed = requests.select("s_suppkey", "project_id", F.coalesce("environment", F.lit("")).alias("environment"))
    found = R.named_environment(environments(spark, d), keyed.select("project_id", "environment").distinct())
    return keyed.join(found, ["project_id", "environment"]).select("s_suppkey", "project_id", "name")


@query(
    "promote_after_delete",
    f"""WITH {ENVIRONMENTS}, {DEFAULT}, l AS (SELECT e.* FROM env_v e WHERE (project_id, name) NOT IN (SELECT (project_id, environment) FROM def_v)),
    lost AS (SELECT project_id FROM def_v JOIN env_v USING (project_id, seq) WHERE env_v.is_default)
    SELECT project_id, name, seq, is_default OR (project_id IN (SELECT project_id FROM lost)
      AND seq = min(seq) OVER (PARTITION BY project_id)) AS is_default FROM l""",
)
def promote_after_delete(spark, d):
    rows = environments(spark, d)
    deleted = R.default_environment(rows).select("project_id", F.col("environment").alias("name"))
    return R.promote_after_delete(rows, deleted).select("project_id", "name", "seq", "is_default")


@query(
    "settle_defaults",
    f"""WITH {ENVIRONMENTS} SELECT project_id, name, seq, seq = coalesce(max(CASE WHEN is_default THEN seq END) OVER (PARTITION BY project_id),
      min(seq) OVER (PARTITION BY project_id)) AS is_default FROM env_v""",
)
def settle_defaults(spark, d):
    return R.settle_defaults(environments(spark, d)).select("project_id", "name", "seq", "is_default")


@query(
    "registry_stats",
    f"""WITH {PROJECTS}, {ENVIRONMENTS} SELECT (SELECT count(*) FROM projects_v) AS projects,
      (SELECT count(*) FROM projects_v WHERE enabled) AS enabled, count(*) AS environments,
      count(*) FILTER (auth_type <> 'None') AS with_auth FROM env_v""",
)
def registry_stats(spark, d):
    return R.registry_stats(projects(spark, d).withColumnRenamed("id", "project_id"), environments(spark, d))
