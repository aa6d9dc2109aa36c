"""The checkpoint directory, and tables stored in it."""

from types import SimpleNamespace

import pytest

from sessionlens.session import ensure_checkpoint_dir, small_side, stored


def test_stored_tables_are_read_back(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS x")
    back = stored(df, "t")
    assert back.schema.simpleString() == df.schema.simpleString() and back.count() == 10
    assert back.inputFiles()[0].replace("file://", "").startswith(ensure_checkpoint_dir(spark).replace("file:", ""))


def test_broadcast_hint_follows_the_bound(spark):
    plan = lambda n: spark.range(5).join(small_side(spark.range(10), n), "id")._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(10) and "strategy=broadcast" not in plan(9)


def test_a_cluster_needs_a_checkpoint_directory():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
