import pytest

from bazaarlake import session


def test_sides_are_broadcast_by_their_counted_size(spark):
    few, many = spark.range(5), spark.range(50)
    base = spark.range(100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda side: base.join(session.small(side, 10), "id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(few)
        assert "BroadcastHashJoin" not in plan(many)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_are_kept_in_the_session_folder(spark):
    folder = session.checkpoint_dir(spark)
    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, v string")
    kept, cut = session.stored(df), session.cut(df)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, cut.collect())) == [(1, "a"), (2, None)]
    assert all(folder.rpartition(":")[2].lstrip("/") in f for f in kept.inputFiles())
    assert kept.dtypes == df.dtypes


def test_a_cluster_without_shared_folder_is_refused(monkeypatch, spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
