"""Session helpers: scan spreading, Parquet materialisation, scratch paths,
package shipping."""

from quire.session import (_SHIPPED, checkpoint_root, ensure_parallelism, materialize,
                           scratch_path, ship_package)


def test_ensure_parallelism_spreads_only_narrow_scans(spark):
    one = spark.range(0, 1000, numPartitions=1)
    wide = spark.range(0, 1000, numPartitions=64)
    assert ensure_parallelism(one, 8).rdd.getNumPartitions() == 8
    assert ensure_parallelism(wide, 8).rdd.getNumPartitions() == 64


def test_materialize_round_trip_and_pruning(spark):
    df = spark.range(0, 500).selectExpr("id", "id * 2 AS twice", "repeat('x', 100) AS pad")
    m = materialize(df, "test")
    assert m.count() == 500 and m.where("twice = 10").first().id == 5
    plan = m.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    assert checkpoint_root(spark).rstrip("/") in scratch_path(spark, "x")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_ship_package_is_idempotent(spark):
    ship_package(spark)
    ship_package(spark)
    assert spark.sparkContext.applicationId in _SHIPPED


def test_a_cluster_that_shares_no_folder_is_refused(monkeypatch):
    from quire import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    import pytest
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
