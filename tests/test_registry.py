from helpers import rows

from lodeline.operators import registry as R

PROJECT = "id int, name string, enabled boolean"
ENV = "project_id int, name string, is_default boolean, seq int, auth_type string"


def test_adding_in_order(spark):
    have = spark.createDataFrame([(i, f"P{i}", True) for i in range(8)], PROJECT)
    asked = spark.createDataFrame(
        [(20, "p1", True, 0), (21, "New", True, 1), (22, "NEW", True, 2), (23, "Other", False, 3), (24, "Late", True, 4)], PROJECT + ", seq int"
    )
    got = rows(R.registry_add(have, asked).where("id >= 20"))
    # a taken name is refused, a repeated one counts once, the eleventh does not fit
    assert got == [(21, "New", True), (23, "Other", False)]
    outcomes = {r.id: r.outcome for r in R.add_requests(have, asked).collect()}
    assert outcomes == {20: "name taken", 21: "added", 22: "asked before", 23: "added", 24: "registry full"}
    assert R.add_requests(have, asked, limit=None).where("outcome = 'added'").count() == 3
    full = spark.createDataFrame([(i, f"P{i}", True) for i in range(10)], PROJECT)
    assert R.registry_add(full, asked).count() == 10


def test_updates(spark):
    have = spark.createDataFrame([(1, "A", True), (2, "B", True), (3, "C", False)], PROJECT)
    asked = spark.createDataFrame([(1, "b", False), (2, "BB", False), (3, "c", True)], PROJECT)
    assert rows(R.registry_update(have, asked)) == [(1, "A", True), (2, "BB", False), (3, "c", True)]
    assert rows(R.load_registry(have).select("id")) == [(1,), (2,)]


def environments(spark):
    return spark.createDataFrame(
        [(1, "dev", False, 0, "None"), (1, "test", True, 1, "Basic"), (1, "live", True, 2, "Bearer"), (2, "dev", False, 5, "None"), (2, "x", False, 4, "None")],
        ENV,
    )


def test_default_environment(spark):
    assert rows(R.default_environment(environments(spark))) == [(1, "test", 1), (2, "x", 4)]


def test_named_environment(spark):
    asked = spark.createDataFrame([(1, "LIVE"), (1, " "), (2, None), (2, "nope")], "project_id int, environment string")
    got = R.named_environment(environments(spark), asked).select("project_id", "name")
    assert rows(got) == [(1, "live"), (1, "test"), (2, "x")]


def test_promotion(spark):
    envs = environments(spark)
    gone = spark.createDataFrame([(1, "test"), (1, "live"), (2, "dev")], "project_id int, name string")
    got = R.promote_after_delete(envs, gone).select("project_id", "name", "is_default")
    # project 2 lost no default, so none is promoted
    assert rows(got) == [(1, "dev", True), (2, "x", False)]


def test_one_default_each(spark):
    got = R.settle_defaults(environments(spark)).where("is_default").select("project_id", "name")
    assert rows(got) == [(1, "live"), (2, "x")]


def test_stats(spark):
    projects = spark.createDataFrame([(1, "A", True), (2, "B", False), (3, "C", True)], "project_id int, name string, enabled boolean")
    assert rows(R.registry_stats(projects, environments(spark))) == [(3, 2, 5, 2)]
