import random

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeline.plans import views as V
from lodeline.sources import index as X
from lodeline.streaming import changes as C
from lodeline.streaming import expiry as E
from lodeline.streaming import jobs as J

EVENT = "project string, path string, old_path string, action string, ts bigint"


def test_feed(spark):
    data = [
        ("p", "a.cs", None, "created", 1), ("p", "a.CS", None, "changed", 2), ("p", "bin/a.cs", None, "changed", 3),
        ("p", "bin/a.cs", None, "deleted", 4), ("p", "new.cs", "old.cs", "renamed", 5), ("p", "new.txt", "old.cs", "renamed", 6), ("p", "a.txt", None, "deleted", 7),
    ]
    got = C.change_feed(spark.createDataFrame(data, EVENT))
    assert rows(got.select("ts", "action", "path")) == [
        (1, "upsert", "a.cs"), (2, "upsert", "a.CS"), (4, "delete", "bin/a.cs"), (5, "delete", "old.cs"), (5, "upsert", "new.cs"), (6, "delete", "old.cs"),
    ]


@pytest.mark.parametrize("hot", [False, True])
def test_debounce_agrees_with_a_window(spark, hot):
    rng = random.Random(3)
    # with hot, one key holds most of the rows
    data = [(0 if hot and rng.random() < 0.8 else rng.randint(0, 9), i, rng.randint(0, 4000)) for i in range(800)]
    df = spark.createDataFrame(data, "k int, id int, at bigint")
    for gap in (1, 7, 300):
        nxt = F.lead("at").over(Window.partitionBy("k").orderBy("at", "id"))
        want = df.withColumn("n", nxt).where(F.col("n").isNull() | (F.col("n") - F.col("at") >= gap)).drop("n")
        assert rows(C.debounce(df, ["k"], "at", gap, F.col("id"))) == rows(want)


def test_a_gap_of_exactly_the_limit_separates(spark):
    df = spark.createDataFrame([("f", 0, 0), ("f", 1, 300), ("f", 2, 599), ("f", 3, 599)], "k string, id int, at bigint")
    assert [r.id for r in C.debounce(df, ["k"], "at", 300, F.col("id")).orderBy("at").collect()] == [0, 3]


def test_apply(spark):
    index = spark.createDataFrame([("p", "a", 1), ("p", "b", 1), ("p", "c", 1)], "project string, path string, n int")
    files = spark.createDataFrame([("p", "a", 2), ("p", "d", 2), ("p", "c", 2)], "project string, path string, n int")
    feed = [("p", "a", "delete", 1), ("p", "a", "upsert", 2), ("p", "b", "upsert", 3), ("p", "c", "upsert", 4), ("p", "c", "delete", 5), ("p", "d", "upsert", 6)]
    changes = spark.createDataFrame(feed, "project string, path string, action string, ts bigint")
    # b is gone by the time it is read
    # c was deleted and is there again
    assert rows(C.apply_changes(index, changes, files, ["project", "path"], ["ts"])) == [("p", "a", 2), ("p", "c", 2), ("p", "d", 2)]


def test_triggers(spark):
    names = spark.createDataFrame([("A",), ("a",), ("b",), ("zz",)], "name string")
    registry = spark.createDataFrame([("a", True), ("B", False), ("C", True)], "name string, enabled boolean")
    assert rows(C.drain_triggers(names, registry)) == [("a",)]


def test_live_entries(spark):
    df = spark.createDataFrame([("a", 0), ("a", 50), ("b", 0), ("c", 200)], "k string, at bigint")
    assert rows(E.live_entries(df, ["k"], "at", 100, 100)) == [("a", 50, 150)]


def test_sliding_lives_agree_with_a_loop(spark):
    rng = random.Random(9)
    data, want = [], []
    for k in range(6):
        times = sorted(rng.sample(range(0, 4000), 120 if k else 400))
        data += [(k, t) for t in times]
        lives = []
        for t in times:
            if lives and t - lives[-1][1] < 24:
                lives[-1][1:] = [t, lives[-1][2] + 1]
            else:
                lives.append([t, t, 1])
        want += [(k, first, last + 24, n) for first, last, n in lives]
    df = spark.createDataFrame(data, "k int, at bigint")
    assert rows(E.sliding_lives(df, ["k"], "at", 24).select("k", "created", "expires", "accesses")) == sorted(want)


def stream(spark, tiny):
    schema = V.table(spark, tiny, "events").schema
    return V.changes(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(tiny))


def test_stream_gives_the_closed_bursts_of_the_batch(spark, tiny, tmp_path):
    hour = 3600000000
    bursts = C.debounce_stream(stream(spark, tiny), ["user_id"], "1 hour", "10 minutes", "event_id", "event_id")
    J.run_to_sink(bursts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")).select("event_id"))
    batch = V.changes(V.table(spark, tiny, "events")).select("user_id", "event_id", "at_us")
    last = batch.agg(F.max("at_us")).first()[0]
    closed = C.debounce(batch, ["user_id"], "at_us", hour, F.col("event_id")).where(F.col("at_us") + hour <= last - hour // 6)
    assert got == rows(closed.select("event_id")) and got


def test_upkeep_can_be_repeated(spark, tiny, tmp_path):
    root = str(tmp_path / "index")
    changes = V.changes(V.table(spark, tiny, "events"))
    start = changes.select("project", "path").distinct().withColumn("n", F.lit(1))
    X.write_index(start, root, buckets=2)
    feed = lambda df: C.change_feed(df.withColumn("ts", F.struct("at_us", "event_id"))).select("project", "path", "action", "ts.at_us", "ts.event_id")
    fresh = start.withColumn("n", F.lit(2)).where("path > 'u/3'")
    results = []
    for run in (1, 2):  # a second stream replays everything
        J.index_upkeep(
            feed(stream(spark, tiny)), root, str(tmp_path / f"state{run}"), start.schema,
            lambda keys: fresh.join(keys, ["project", "path"], "left_semi"), ["project", "path"], ["at_us", "event_id", "action"],
        ).awaitTermination()
        results.append(rows(X.read_index(spark, root, start.schema).select("project", "path", "n")))
    want = rows(C.apply_changes(start, feed(changes), fresh, ["project", "path"], ["at_us", "event_id", "action"]).select("project", "path", "n"))
    assert results == [want, want]


def test_late_delete_does_not_remove_a_file_that_exists(spark, tiny, tmp_path):
    from lodeline.sources import index as X

    schema = "project string, path string, action string, ts bigint"
    root = str(tmp_path / "index")
    X.write_index(spark.createDataFrame([("p", "z.cs", "old")], "project string, path string, state string"), root)
    now = spark.createDataFrame([("p", "a.cs", "new")], "project string, path string, state string")
    for i, rows_ in enumerate([[("p", "a.cs", "upsert", 100)], [("p", "a.cs", "delete", 50), ("p", "z.cs", "delete", 60)]]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        J.index_upkeep(
            changes, root, f"{tmp_path}/state", now.schema, lambda keys: now.join(keys, ["project", "path"], "left_semi"),
            ["project", "path"], ["ts", "action"],
        ).awaitTermination()
    assert rows(X.read_index(spark, root, now.schema).select("path", "state")) == [("a.cs", "new")]


def feed(spark, tmp_path, name, i, data, schema):
    """Write one more part of an input and give the stream of all its parts."""
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/{i}")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/*")


MS = 1000
SECOND = 1000 * MS


def drained_bursts(spark, tmp_path, batches, gap, delay="0 seconds"):
    """What a stream of changes has given out after each of the batches (changes, clock)."""
    seen, progress = [], []
    for i, (data, clock) in enumerate(batches):
        changes = feed(spark, tmp_path, "in", i, data, "k int, at bigint, id bigint")
        ticks = feed(spark, tmp_path, "ticks", i, [(clock,)] if clock is not None else [], "at bigint")
        bursts = C.quiet_bursts(changes, ["k"], "at", gap, "id", ticks, delay)
        query = J.run_to_sink(bursts, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        progress += query.recentProgress
        seen.append(rows(spark.read.schema("k int, at bigint, id bigint").parquet(f"{tmp_path}/out").select("id")))
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    return seen, dropped


def test_a_burst_goes_on_after_a_restart_and_a_quiet_input_still_ends_it(spark, tmp_path):
    batches = [
        ([(1, 1 * SECOND, 1), (2, 5 * SECOND, 2)], None),
        # the burst of key 1 ended while the stream was down, that of key 2 goes on
        ([(2, 5 * SECOND + 400 * MS, 3)], None),
        ([], 5 * SECOND + 800 * MS),
        ([], 6 * SECOND),
        ([], 6 * SECOND),
    ]
    seen, dropped = drained_bursts(spark, tmp_path, batches, SECOND // 2)
    assert seen == [[(1,)], [(1,)], [(1,)], [(1,), (3,)], [(1,), (3,)]]
    assert dropped == 0


def test_stream_separates_at_exactly_the_gap(spark, tmp_path):
    at = [0, 500 * MS, 1000 * MS - 1, 1000 * MS - 1, 1500 * MS - 1]
    data = [(1, 10 * SECOND + t, i) for i, t in enumerate(at)]
    seen, _ = drained_bursts(spark, tmp_path, [(data, None), ([], 60 * SECOND)], SECOND // 2)
    assert seen[-1] == [(0,), (3,), (4,)]


def test_rows_within_the_delay_count_and_later_ones_are_reported(spark, tmp_path):
    batches = [
        ([(1, 10 * SECOND, 1), (2, 20 * SECOND, 2)], None),
        ([(1, 10 * SECOND + 100 * MS, 3), (3, 1 * SECOND, 4), (None, 30 * SECOND, 5), (3, None, 6)], None),
        ([], 90 * SECOND),
    ]
    seen, dropped = drained_bursts(spark, tmp_path, batches, SECOND // 2, "15 seconds")
    assert seen[-1] == [(2,), (3,), (5,)]
    assert dropped == 1


def test_stream_of_bursts_agrees_with_the_batch(spark, tmp_path):
    rng = random.Random(11)
    times = sorted((0 if rng.random() < 0.6 else rng.randint(0, 5), rng.randint(0, 400) * 50 * MS) for _ in range(400))
    data = sorted([(k, SECOND + t, i) for i, (k, t) in enumerate(times)], key=lambda r: r[1])
    cuts = [data[:150], data[150:300], data[300:]]
    seen, dropped = drained_bursts(spark, tmp_path, [*[(part, None) for part in cuts], ([], 100 * SECOND)], SECOND // 5, "1 second")
    whole = spark.createDataFrame(data, "k int, at bigint, id bigint")
    assert seen[-1] == rows(C.debounce(whole, ["k"], "at", SECOND // 5, F.col("id")).select("id"))
    assert dropped == 0


def test_expirations_agree_with_lives_and_survive_restarts(spark, tmp_path):
    writes = [[("a", 1 * SECOND), ("b", 2 * SECOND)], [("a", 1 * SECOND + 900 * MS), ("c", 4 * SECOND), (None, 4 * SECOND)], []]
    for i, data in enumerate(writes):
        stream = feed(spark, tmp_path, "in", i, data, "k string, at bigint")
        ticks = feed(spark, tmp_path, "ticks", i, [] if data else [(9 * SECOND,)], "at bigint")
        lives = E.expirations(stream, ["k"], "at", SECOND, ticks, "1 second")
        J.run_to_sink(lives, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    name = F.coalesce("k", F.lit("null"))
    got = spark.read.parquet(f"{tmp_path}/out").select(name, "created_at", "expires_at", "writes")
    want = spark.createDataFrame([row for part in writes for row in part], "k string, at bigint")
    assert rows(got) == rows(E.sliding_lives(want, ["k"], "at", SECOND).select(name, "created", "expires", "accesses"))
    assert got.count() == 4
