"""Physical-planning helpers: size-checked broadcast and scan spreading."""

import pytest

from flowmatch import session
from flowmatch.session import bounded_broadcast, checkpoint_dir, get_spark, spread


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_broadcast_has_a_fallback(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(0, 100_000).withColumnRenamed("id", "k")
        small = spark.range(0, 10).withColumnRenamed("id", "k")
        assert "BroadcastHashJoin" in _plan(big.join(bounded_broadcast(small, max_bytes=1000), "k"))
        assert "BroadcastHashJoin" not in _plan(big.join(bounded_broadcast(big, max_bytes=1000), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_only_when_splits_are_few(spark):
    slots = spark.sparkContext.defaultParallelism
    one = spark.range(0, 1000, numPartitions=1)
    many = spark.range(0, 1000, numPartitions=slots * 2)
    assert spread(one, "id").rdd.getNumPartitions() == slots
    assert spread(many, "id") is many


def test_checkpoint_dir_is_reused(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_a_preset_shuffle_setting_survives(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert get_spark(shuffle_partitions=5).conf.get("spark.sql.shuffle.partitions") == "37"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_cluster_must_name_its_checkpoint_folder(monkeypatch):
    class Nothing:
        def isDefined(self):
            return False

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "yarn"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            return Nothing()
                    return Context

    assert not session.is_local(Cluster)
    with pytest.raises(RuntimeError):
        checkpoint_dir(Cluster)
