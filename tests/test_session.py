from tessera import session as S


def test_checkpoint_dir_is_read_from_the_session(spark):
    d = S.checkpoint_root(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    # asking again never replaces a configured folder
    assert S.checkpoint_root(spark) == d
    p = S.scratch_path(spark, "x")
    assert p.startswith(d.rstrip("/") + "/tessera-x-")


def test_cluster_profile_sizes():
    c = S.CLUSTER_CONF
    assert c["spark.sql.adaptive.enabled"] == "true"
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(c["spark.sql.shuffle.partitions"]) >= 1000
    # broadcasts stay bounded by a fixed size, never by the data
    assert c["spark.sql.autoBroadcastJoinThreshold"] == c["spark.sql.adaptive.autoBroadcastJoinThreshold"] == "64m"


def test_cluster_without_shared_folder_is_an_error():
    import pytest

    from tessera import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf())

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_released_state_is_deleted(spark):
    from tessera.operators.iterate import cut_to_table, release
    df = cut_to_table(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os
    assert os.path.isdir(path) and df.count() == 5
    release(df)
    assert not os.path.exists(path)
