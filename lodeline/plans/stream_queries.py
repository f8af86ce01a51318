"""Queries over the change feed, in batch and as streams."""

from pyspark.sql import functions as F

from lodeline.plans import views as V
from lodeline.plans.registered import fresh_dir, query
from lodeline.sources import index as X
from lodeline.streaming import changes as C
from lodeline.streaming import expiry as E
from lodeline.streaming import jobs as J

HOUR = 3600000000
DAY = 24 * HOUR
NOW = 1705363200000000
BASE = f"WITH {V.CHANGES}"


def batch(spark, d):
    return V.changes(V.table(spark, d, "events"))


def stream(spark, d):
    schema = V.table(spark, d, "events").schema
    return V.changes(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def drained(spark, frame, label):
    """Run a stream until its input is used up and read what it wrote."""
    root = fresh_dir(spark, label)
    J.run_to_sink(frame, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{root}/out")


FEED = """feed_v AS (
  SELECT event_id, project, path, 'upsert' AS action, at_us, ts FROM changes_v WHERE action IN ('created', 'changed', 'renamed')
  UNION ALL SELECT event_id, project, path, 'delete', at_us, ts FROM changes_v WHERE action = 'deleted'
  UNION ALL SELECT event_id, project, old_path, 'delete', at_us, ts FROM changes_v WHERE action = 'renamed')"""


@query("change_feed", f"{BASE}, {FEED} SELECT project, path, action, at_us FROM feed_v")
def change_feed(spark, d):
    rows = batch(spark, d).withColumn("ts", F.col("at_us"))
    return C.change_feed(rows).withColumnRenamed("ts", "at_us")


@query("change_feed_stream", f"{BASE}, {FEED} SELECT project, path, action, at_us FROM feed_v")
def change_feed_stream(spark, d):
    feed = C.change_feed(stream(spark, d).withColumn("ts", F.col("at_us"))).withColumnRenamed("ts", "at_us")
    return drained(spark, feed, "change-feed")


def debounce_sql(gap: int) -> str:
    return f"""SELECT user_id, event_id, action, at_us FROM (SELECT *, lead(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS nxt
      FROM changes_v) x WHERE nxt IS NULL OR nxt - at_us >= {gap}"""


@query("debounce_changes", f"{BASE} {debounce_sql(HOUR)}")
def debounce_changes(spark, d):
    rows = batch(spark, d).select("user_id", "event_id", "action", "at_us")
    return C.debounce(rows, ["user_id"], "at_us", HOUR, F.col("event_id"))


@query("debounce_default_gap", f"{BASE} {debounce_sql(300000)}")
def debounce_default_gap(spark, d):
    rows = batch(spark, d).select("user_id", "event_id", "action", "at_us")
    return C.debounce(rows, ["user_id"], "at_us", 300000, F.col("event_id"))


def in_parts(spark, d, run, root, parts=4):
    """Feed the events to a stream in order of time: every part is written, then ``run`` drains what is new.

    A part has as many files as the table has tasks, and one run takes them all, so
    no task sees more than its share. ``run(stream, ticks)`` gives a query; the last
    run has no events, only a tick of the clock past all that is open.
    """
    events = V.table(spark, d, "events")
    bounds = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    step = (bounds["high"] - bounds["low"]) / parts
    clock = spark.range(1).select(F.lit(CLOCK).alias("at"))
    clock.where("false").write.parquet(f"{root}/ticks/none")
    for i in range(parts + 1):
        if i < parts:
            low = F.col("ts") >= F.lit(bounds["low"] + i * step) if i else F.lit(True)
            high = F.col("ts") < F.lit(bounds["low"] + (i + 1) * step) if i < parts - 1 else F.lit(True)
            events.where(low & high).write.parquet(f"{root}/in/{i}")
        else:
            clock.write.parquet(f"{root}/ticks/last")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in/*")
        ticks = spark.readStream.schema(clock.schema).parquet(f"{root}/ticks/*")
        run(stream, ticks).awaitTermination()


# A time after all events.
CLOCK = 4102444800000000


@query("debounce_stream", f"{BASE}, b AS ({debounce_sql(HOUR)}) SELECT user_id, event_id, action FROM b")
def debounce_stream(spark, d):
    """Four runs over the events, then the last bursts once the clock has passed their gap."""
    root = fresh_dir(spark, "debounce")

    def run(events, ticks):
        rows = V.changes(events).select("user_id", "event_id", "action", "at_us")
        bursts = C.quiet_bursts(rows, ["user_id"], "at_us", HOUR, "event_id", ticks)
        return J.run_to_sink(bursts.select("user_id", "event_id", "action"), f"{root}/out", f"{root}/state")

    in_parts(spark, d, run, root)
    return spark.read.parquet(f"{root}/out")


# Index upkeep -----------------------------------------------------------------

# the index starts with every path; files of users below 100 still exist
FINAL = """latest_v AS (SELECT project, path, arg_max(action, (at_us, event_id, action)) AS action FROM feed_v GROUP BY project, path),
start_v AS (SELECT DISTINCT project, path FROM changes_v),
files_now AS (SELECT DISTINCT project, path FROM changes_v WHERE user_id < 100),
final_v AS (SELECT project, path, 'old' AS state FROM start_v WHERE (project, path) NOT IN (SELECT (project, path) FROM latest_v)
  UNION ALL SELECT project, path, 'new' FROM files_now WHERE (project, path) IN (SELECT (project, path) FROM latest_v))"""


def feed_with_order(rows):
    """The feed with its order columns packed into the time column."""
    packed = rows.withColumn("ts", F.struct("at_us", "event_id"))
    return C.change_feed(packed).select("project", "path", "action", "ts.at_us", "ts.event_id")


@query("apply_changes", f"{BASE}, {FEED}, {FINAL} SELECT * FROM final_v")
def apply_changes(spark, d):
    rows = batch(spark, d)
    paths = rows.select("project", "path").distinct()
    start = paths.withColumn("state", F.lit("old"))
    now = rows.where("user_id < 100").select("project", "path").distinct().withColumn("state", F.lit("new"))
    return C.apply_changes(start, feed_with_order(rows), now, ["project", "path"], ["at_us", "event_id", "action"])


@query("index_upkeep_stream", f"{BASE}, {FEED}, {FINAL} SELECT * FROM final_v")
def index_upkeep_stream(spark, d):
    """Four runs over the feed."""
    rows = batch(spark, d)
    start = rows.select("project", "path").distinct().withColumn("state", F.lit("old"))
    now = rows.where("user_id < 100").select("project", "path").distinct().withColumn("state", F.lit("new"))
    root = fresh_dir(spark, "upkeep")
    X.write_index(start, f"{root}/index")

    def run(events, ticks):
        return J.index_upkeep(
            feed_with_order(V.changes(events)),
            f"{root}/index",
            f"{root}/state",
            start.schema,
            lambda keys: now.join(keys, ["project", "path"], "left_semi"),
            ["project", "path"],
            ["at_us", "event_id", "action"],
        )

    in_parts(spark, d, run, root)
    return X.read_index(spark, f"{root}/index", start.schema).select("project", "path", "state")


@query("watch_job", f"{BASE}, {FEED}, {FINAL} SELECT * FROM final_v")
def watch_job(spark, d):
    """Feed, debounce per path and upkeep in one job: four runs, and one by the clock."""
    rows = batch(spark, d)
    start = rows.select("project", "path").distinct().withColumn("state", F.lit("old"))
    now = rows.where("user_id < 100").select("project", "path").distinct().withColumn("state", F.lit("new"))
    root = fresh_dir(spark, "watch")
    X.write_index(start, f"{root}/index")

    def run(events, ticks):
        changes = V.changes(events).select("project", "path", "old_path", "action", F.col("at_us").alias("ts"), F.col("event_id").alias("seq"))
        load = lambda keys: now.join(keys, ["project", "path"], "left_semi")
        return J.watch_job(changes, ticks, f"{root}/index", f"{root}/checkpoint", start.schema, load, HOUR)

    in_parts(spark, d, run, root)
    return X.read_index(spark, f"{root}/index", start.schema).select("project", "path", "state")


REGISTRY = "registry_v AS (SELECT DISTINCT project, project <> 'p3' AS enabled FROM changes_v)"


def registry(spark, d):
    names = batch(spark, d).select(F.col("project").alias("name")).distinct()
    return names.withColumn("enabled", F.col("name") != "p3")


@query("drain_triggers", f"{BASE}, {REGISTRY} SELECT project FROM registry_v WHERE enabled")
def drain_triggers(spark, d):
    shout = F.when(F.col("event_id") % 2 == 0, F.upper("project")).otherwise(F.col("project"))
    return C.drain_triggers(batch(spark, d).select(shout.alias("name")), registry(spark, d))


@query("drain_triggers_stream", f"""{BASE}, {REGISTRY} SELECT DISTINCT r.project, event_id % 2 AS run FROM changes_v c
  JOIN registry_v r ON r.project = c.project WHERE enabled""")
def drain_triggers_stream(spark, d):
    """Two runs: a project that is asked for again counts again."""
    shout = F.when(F.col("event_id") % 2 == 0, F.upper("project")).otherwise(F.col("project"))
    rows = batch(spark, d).select(shout.alias("name"), (F.col("event_id") % 2).alias("run"))
    known, root = registry(spark, d), fresh_dir(spark, "triggers")
    for run in (0, 1):
        rows.where(F.col("run") == run).select("name").write.parquet(f"{root}/in/{run}")
        names = spark.readStream.schema("name string").parquet(f"{root}/in/*")
        J.drain_job(names, known, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("project", F.col("batch").cast("bigint").alias("run"))


# Expiry -----------------------------------------------------------------------


@query(
    "live_entries",
    f"""{BASE} SELECT user_id, max(at_us) AS last_write, max(at_us) + {DAY} AS expires_at FROM changes_v
    WHERE at_us <= {NOW} GROUP BY user_id HAVING max(at_us) + {DAY} > {NOW}""",
)
def live_entries(spark, d):
    return E.live_entries(batch(spark, d), ["user_id"], "at_us", DAY, NOW)


@query(
    "expirations_stream",
    f"""{BASE}, g AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us) < {DAY} THEN 0 ELSE 1 END AS starts FROM changes_v),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, min(at_us) AS created_at, max(at_us) + {DAY} AS expires_at, count(*) AS writes FROM s GROUP BY user_id, run""",
)
def expirations_stream(spark, d):
    """Four runs over the writes, then the last lives once the clock has passed their end."""
    root = fresh_dir(spark, "expirations")

    def run(events, ticks):
        lives = E.expirations(V.changes(events).select("user_id", "at_us"), ["user_id"], "at_us", DAY, ticks)
        return J.run_to_sink(lives, f"{root}/out", f"{root}/state")

    in_parts(spark, d, run, root)
    return spark.read.parquet(f"{root}/out").select("user_id", "created_at", "expires_at", "writes")


@query(
    "sliding_lives",
    f"""{BASE}, g AS (SELECT user_id, at_us, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us) < {DAY} THEN NULL ELSE at_us END AS s FROM changes_v),
    r AS (SELECT user_id, at_us, max(s) OVER (PARTITION BY user_id ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS created FROM g)
    SELECT user_id, created, max(at_us) + {DAY} AS expires, count(*) AS accesses FROM r GROUP BY user_id, created""",
)
def sliding_lives(spark, d):
    return E.sliding_lives(batch(spark, d), ["user_id"], "at_us", DAY)
