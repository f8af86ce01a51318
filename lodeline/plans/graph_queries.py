"""Queries over call sites and dependency edges."""

from pyspark.sql import functions as F

from lodeline.operators import callgraph as G
from lodeline.operators import depgraph as D
from lodeline.plans import views as V
from lodeline.plans.registered import query

BASE = f"WITH {V.CALLS}"

TARGETS = """targets_v AS (
  SELECT 'P' || p_partkey AS target_method, 'o/' || (p_partkey * 7) || '.cs' AS target_path FROM part)"""


def part_targets(spark, d):
    key = F.col("p_partkey")
    return V.table(spark, d, "part").select(
        V.text("P", key).alias("target_method"), V.text("o/", key * 7, ".cs").alias("target_path")
    )


@query(
    "callers",
    f"""{BASE}, {TARGETS} SELECT target_method, path, caller_class, caller_method, line
    FROM calls_v JOIN targets_v ON callee_method = target_method AND path <> target_path""",
)
def callers(spark, d):
    return G.callers(V.calls(spark, d), part_targets(spark, d)).select(
        "target_method", "path", "caller_class", "caller_method", "line"
    )


INSIDE = """inside_v AS (
  SELECT DISTINCT 'o/' || o_orderkey || '.cs' AS path, 'S' || (o_custkey % 100) AS class_name,
         'M' || (o_orderkey % 7 + 1) AS method_name FROM orders)"""


def order_targets(spark, d):
    return V.table(spark, d, "orders").select(
        V.text("o/", F.col("o_orderkey"), ".cs").alias("path"),
        V.text("S", F.col("o_custkey") % 100).alias("class_name"),
        V.text("M", F.col("o_orderkey") % 7 + 1).alias("method_name"),
    )


@query(
    "callees",
    f"""{BASE}, {INSIDE} SELECT path, caller_class, caller_method, callee_class, callee_method, calls_v.line
    FROM calls_v SEMI JOIN inside_v USING (path) WHERE (path, caller_class, caller_method) IN
      (SELECT (path, class_name, method_name) FROM inside_v)""",
)
def callees(spark, d):
    return G.callees(V.calls(spark, d), order_targets(spark, d)).select(
        "path", "caller_class", "caller_method", "callee_class", "callee_method", "line"
    )


@query(
    "find_targets",
    f"""WITH {V.METHODS}, {INSIDE}, w AS (
      SELECT path, method_name, CASE WHEN CAST(substr(class_name, 2) AS INT) % 2 = 0 THEN class_name ELSE '' END AS wanted_class
      FROM inside_v),
    pc AS (SELECT path, method_name, class_name, min(line) AS line FROM methods_v GROUP BY ALL),
    c AS (SELECT path, method_name, count(*) AS classes, arg_min(class_name, (line, class_name)) AS sole FROM pc GROUP BY ALL),
    j AS (SELECT w.path, w.method_name, wanted_class, classes, CASE WHEN classes = 1 THEN sole ELSE wanted_class END AS class_name
      FROM w LEFT JOIN c ON c.path = w.path AND c.method_name = w.method_name)
    SELECT j.path, j.method_name, wanted_class, j.class_name, coalesce(pc.line, -1) AS line,
      CASE WHEN classes IS NULL THEN 'not_found' WHEN classes > 1 AND wanted_class = '' THEN 'class_required'
        WHEN pc.line IS NULL THEN 'class_not_found' ELSE 'ok' END AS status
    FROM j LEFT JOIN pc ON pc.path = j.path AND pc.method_name = j.method_name AND pc.class_name = j.class_name""",
)
def find_targets(spark, d):
    number = F.substring("class_name", 2, 10).cast("int")
    wanted = order_targets(spark, d).withColumn("class_name", F.when(number % 2 == 0, F.col("class_name")))
    return G.find_target(V.methods(spark, d), wanted).withColumn("line", F.coalesce("line", F.lit(-1)))


@query(
    "class_count_per_file",
    f"""{BASE}, c AS (SELECT path, count(DISTINCT caller_class) AS n FROM calls_v GROUP BY path)
    SELECT path, caller_class, line, n AS classes_in_file, n = 1 AS is_single_class,
      CASE WHEN n = 1 THEN '' ELSE ' (className: `' || caller_class || '`)' END AS hint FROM calls_v JOIN c USING (path)""",
)
def class_count_per_file(spark, d):
    calls = V.calls(spark, d)
    hint = G.caller_hint(F.col("caller_class"), F.col("is_single_class"))
    return G.with_class_count(calls, calls, "caller_class").select(
        "path", "caller_class", "line", "classes_in_file", "is_single_class", hint.alias("hint")
    )


# calls on odd lines go to methods that call as well
BOTH = "both_v AS (SELECT * REPLACE (CASE WHEN line % 2 = 1 THEN 'M' || (line % 9) ELSE callee_method END AS callee_method) FROM calls_v)"


def both_ways(spark, d):
    to = F.when(F.col("line") % 2 == 1, V.text("M", F.col("line") % 9)).otherwise(F.col("callee_method"))
    return V.calls(spark, d).withColumn("callee_method", to)


@query(
    "graph_totals",
    f"""{BASE}, {BOTH}, {INSIDE}, i AS (SELECT t.path, class_name, method_name, count(c.path) AS inbound, count(DISTINCT c.path) AS files
      FROM inside_v t LEFT JOIN both_v c ON c.callee_method = t.method_name AND c.path <> t.path GROUP BY ALL),
    o AS (SELECT i.path, i.class_name, i.method_name, count(c.path) AS outbound FROM inside_v i
      LEFT JOIN both_v c ON c.path = i.path AND c.caller_class = i.class_name AND c.caller_method = i.method_name GROUP BY ALL)
    SELECT * FROM i JOIN o USING (path, class_name, method_name)""",
)
def graph_totals(spark, d):
    return G.graph_totals(both_ways(spark, d), order_targets(spark, d))


@query(
    "graph_outbound",
    f"""{BASE}, {INSIDE} SELECT i.path, i.class_name, i.method_name, count(c.path) AS outbound FROM inside_v i
    LEFT JOIN calls_v c ON c.path = i.path AND c.caller_class = i.class_name AND c.caller_method = i.method_name GROUP BY ALL""",
)
def graph_outbound(spark, d):
    return G.graph_totals(V.calls(spark, d), order_targets(spark, d)).select(
        "path", "class_name", "method_name", "outbound"
    )


@query(
    "call_categories",
    f"""{BASE} SELECT caller_class, CASE WHEN callee_class = 'SameClass' THEN 'same'
      WHEN contains(callee_class, 'System') OR callee_class = 'Unknown' THEN 'system' ELSE 'external' END AS category,
      count(*) AS calls FROM calls_v GROUP BY ALL""",
)
def call_categories(spark, d):
    return G.call_categories(V.calls(spark, d), "caller_class")


@query(
    "external_calls",
    f"""{BASE} SELECT * FROM calls_v EXCEPT ALL (SELECT * FROM calls_v WHERE callee_class = 'SameClass'
      UNION ALL SELECT * FROM calls_v WHERE contains(callee_class, 'System') OR callee_class = 'Unknown')""",
)
def external_calls(spark, d):
    return G.external_calls(V.calls(spark, d))


@query(
    "call_graph",
    f"""{BASE}, {BOTH}, t AS (SELECT path, caller_class, caller_method FROM both_v WHERE caller_method IN (SELECT callee_method FROM both_v)
      ORDER BY path, caller_class, caller_method LIMIT 1)
    SELECT * FROM (SELECT 'caller' AS direction, c.path, c.caller_class AS class_name, c.caller_method AS method_name, c.line
      FROM both_v c, t WHERE c.callee_method = t.caller_method AND c.path <> t.path
      ORDER BY c.path, c.line, c.caller_class, c.caller_method, c.callee_class LIMIT 20) x
    UNION ALL SELECT 'callee', c.path, c.callee_class, c.callee_method, c.line FROM both_v c, t
      WHERE c.path = t.path AND c.caller_class = t.caller_class AND c.caller_method = t.caller_method""",
)
def call_graph(spark, d):
    calls = both_ways(spark, d)
    named = calls.select(F.col("callee_method").alias("caller_method")).distinct()
    target = calls.join(named, "caller_method", "left_semi").orderBy("path", "caller_class", "caller_method").first()
    return G.call_graph(calls, target["path"], target["caller_class"], target["caller_method"])


@query(
    "dependency_edges",
    """SELECT DISTINCT 'lines' AS project, 'S' || l_suppkey AS from_type, 'P' || l_partkey AS to_type FROM lineitem""",
)
def dependency_edges(spark, d):
    params = V.table(spark, d, "lineitem").select(
        F.lit("lines").alias("project"),
        V.text("S", F.col("l_suppkey")).alias("type_name"),
        V.text("P", F.col("l_partkey")).alias("type"),
    )
    return G.dependency_edges(params)


@query(
    "dependency_degrees",
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
    SELECT 'S' || s AS type, 'out' AS side, count(*) AS edges FROM e GROUP BY s
    UNION ALL SELECT 'P' || p, 'in', count(*) FROM e GROUP BY p""",
)
def dependency_degrees(spark, d):
    edges = dependency_edges(spark, d)
    side = F.explode(
        F.array(
            F.struct(F.col("from_type").alias("type"), F.lit("out").alias("side")),
            F.struct(F.col("to_type").alias("type"), F.lit("in").alias("side")),
        )
    )
    return edges.select(side.alias("e")).groupBy("e.type", "e.side").agg(F.count("*").alias("edges"))


# Types of a project depend on types with higher numbers, and now and then on lower ones.
DEPS = """deps_v AS (
  SELECT 'L' || (o_custkey // 60) || ':T' || f AS from_type, 'L' || (o_custkey // 60) || ':T' ||
    (CASE WHEN o_orderkey % 25 = 0 THEN greatest(f - o_custkey % 60, 0) ELSE f + 8 + o_orderkey % 45 END) AS to_type,
    CASE o_orderstatus WHEN 'F' THEN 'ConstructorInjection' WHEN 'O' THEN 'PropertyInjection' ELSE 'MethodParameter' END AS source
  FROM (SELECT *, (o_orderkey * 13 + o_custkey) % 120 AS f FROM orders)),
edges_v AS (SELECT DISTINCT from_type, to_type FROM deps_v)"""
REACH = "reach AS (SELECT from_type AS a, to_type AS b FROM edges_v UNION SELECT a, to_type FROM reach JOIN edges_v ON b = from_type)"
COMPONENTS = """nodes AS (SELECT from_type AS node FROM edges_v UNION SELECT to_type FROM edges_v),
  comps AS (SELECT node, least(node, coalesce(min(x.b), node)) AS cycle, count(x.b) > 0 AS cyclic
    FROM nodes LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a) x ON x.a = node GROUP BY node),
  sizes AS (SELECT cycle, count(*) AS members FROM comps GROUP BY cycle),
  between AS (SELECT DISTINCT f.cycle AS c, t.cycle AS d FROM edges_v JOIN comps f ON from_type = f.node JOIN comps t ON to_type = t.node
    WHERE f.cycle <> t.cycle)"""


def dependencies(spark, d):
    orders = V.table(spark, d, "orders").withColumn("f", (F.col("o_orderkey") * 13 + F.col("o_custkey")) % 120)
    back = F.greatest(F.col("f") - F.col("o_custkey") % 60, F.lit(0))
    to = F.when(F.col("o_orderkey") % 25 == 0, back).otherwise(F.col("f") + 8 + F.col("o_orderkey") % 45)
    project = F.expr("o_custkey div 60")
    status = F.col("o_orderstatus")
    source = F.when(status == "F", "ConstructorInjection").when(status == "O", "PropertyInjection").otherwise("MethodParameter")
    return orders.select(
        V.text("L", project, ":T", F.col("f")).alias("from_type"), V.text("L", project, ":T", to).alias("to_type"), source.alias("source")
    )


@query(
    "dependency_cycles",
    f"""WITH RECURSIVE {DEPS}, {REACH}, {COMPONENTS},
    inner_v AS (SELECT f.cycle, from_type, to_type FROM edges_v JOIN comps f ON from_type = f.node JOIN comps t ON to_type = t.node
      WHERE f.cycle = t.cycle AND f.cyclic),
    away AS (SELECT DISTINCT cycle, cycle AS node, 0 AS d FROM comps WHERE cyclic
      UNION SELECT i.cycle, from_type, d + 1 FROM away JOIN inner_v i ON i.cycle = away.cycle AND to_type = away.node
        JOIN sizes z ON z.cycle = i.cycle WHERE d < z.members),
    nearest AS (SELECT cycle, node, min(d) AS d FROM away GROUP BY ALL),
    lengths AS (SELECT cycle, min(d) AS length FROM away WHERE node = cycle AND d > 0 GROUP BY cycle),
    walks AS (SELECT cycle, length, cycle AS node, [cycle] AS path FROM lengths
      UNION ALL SELECT w.cycle, length, i.to_type, list_append(path, i.to_type) FROM walks w
        JOIN inner_v i ON i.cycle = w.cycle AND i.from_type = w.node
        JOIN nearest n ON n.cycle = w.cycle AND n.node = i.to_type AND n.d = length - len(path) WHERE len(path) < length)
    SELECT cycle, members, length::INT AS length, array_to_string(min(path), ' -> ') AS path FROM walks JOIN sizes USING (cycle)
    WHERE len(path) = length GROUP BY ALL""",
)
def dependency_cycles(spark, d):
    return D.Condensed(dependencies(spark, d)).cycles()


@query(
    "cycle_members",
    f"""WITH RECURSIVE {DEPS}, {REACH}, {COMPONENTS} SELECT cycle, node FROM comps WHERE cyclic""",
)
def cycle_members(spark, d):
    return D.Condensed(dependencies(spark, d)).cycle_members()


@query(
    "dependency_depth",
    f"""WITH RECURSIVE {DEPS}, {REACH}, {COMPONENTS},
    deep AS (SELECT DISTINCT cycle AS c, 0 AS d FROM comps UNION SELECT between.c, deep.d + 1 FROM deep JOIN between ON between.d = deep.c)
    SELECT node, max(d)::INT AS depth FROM comps JOIN deep ON c = cycle GROUP BY node""",
)
def dependency_depth(spark, d):
    return D.Condensed(dependencies(spark, d)).depths()


@query(
    "transitive_dependencies",
    f"""WITH RECURSIVE {DEPS}, {REACH}, nodes AS (SELECT from_type AS node FROM edges_v UNION SELECT to_type FROM edges_v)
    SELECT node, count(b) FILTER (b <> node) AS reached FROM nodes LEFT JOIN reach ON a = node GROUP BY node""",
)
def transitive_dependencies(spark, d):
    return D.Condensed(dependencies(spark, d)).reach()


@query(
    "graph_statistics",
    f"""WITH {DEPS}, n AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT from_type AS node, 1 AS o, 0 AS i FROM edges_v
      UNION ALL SELECT to_type, 0, 1 FROM edges_v) GROUP BY node)
    SELECT 'total_classes' AS measure, NULL::VARCHAR AS name, count(*)::DOUBLE AS value FROM n
    UNION ALL SELECT 'total_dependencies', NULL, sum(o)::DOUBLE FROM n
    UNION ALL SELECT 'mean_dependencies', NULL, sum(o)::DOUBLE / count(*) FROM n
    UNION ALL SELECT 'dependencies_by_source', source, count(DISTINCT (from_type, to_type))::DOUBLE FROM deps_v GROUP BY source
    UNION ALL (SELECT 'most_depended_upon', node, i::DOUBLE FROM n WHERE i > 0 ORDER BY i DESC, node LIMIT 10)
    UNION ALL (SELECT 'most_dependent', node, o::DOUBLE FROM n WHERE o > 0 ORDER BY o DESC, node LIMIT 10)
    UNION ALL SELECT 'god_class', node, (o + i)::DOUBLE FROM n WHERE o + i >= 14""",
)
def graph_statistics(spark, d):
    return D.statistics(dependencies(spark, d), god_class_degree=14)


@query(
    "call_levels",
    f"""WITH RECURSIVE {DEPS}, targets AS (SELECT DISTINCT to_type AS target FROM edges_v WHERE to_type LIKE '%0'),
    up AS (SELECT target, from_type AS method, 1 AS level FROM targets JOIN edges_v ON to_type = target
      UNION SELECT target, from_type, level + 1 FROM up JOIN edges_v ON to_type = method WHERE level < 3),
    down AS (SELECT target, to_type AS method, 1 AS level FROM targets JOIN edges_v ON from_type = target
      UNION SELECT target, to_type, level + 1 FROM down JOIN edges_v ON from_type = method WHERE level < 3),
    found AS (SELECT 'callers' AS direction, target, method, min(level)::INT AS level FROM up GROUP BY ALL
      UNION ALL SELECT 'callees', target, method, min(level)::INT FROM down GROUP BY ALL)
    SELECT *, ceil(row_number() OVER (PARTITION BY direction, target, level ORDER BY method) / 5)::BIGINT AS page,
      ceil(count(*) OVER (PARTITION BY direction, target, level) / 5)::BIGINT AS total_pages FROM found""",
)
def call_levels(spark, d):
    calls = dependencies(spark, d).select(F.col("from_type").alias("caller"), F.col("to_type").alias("callee"))
    targets = calls.where(F.endswith("callee", F.lit("0"))).select(F.col("callee").alias("target"))
    sides = [
        G.level_pages(G.call_levels(calls, targets, 3, direction), 5).withColumn("direction", F.lit(direction))
        for direction in ("callers", "callees")
    ]
    return sides[0].unionByName(sides[1])
