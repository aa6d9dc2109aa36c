"""Keyed tables, checked joins, dirty CSV, the expiring gauge, and what a stream leaves behind."""

import os
import uuid

import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sessionlens.operators.checked import zip_by_key
from sessionlens.session import discard, scratch_path, stored
from sessionlens.sources import readers as R
from sessionlens.sources import upsert as UP
from sessionlens.sources.vectors import read_keyed, write_keyed
from sessionlens.streaming import live as L


def test_bucketed_tables_join_without_a_shuffle(spark):
    a = spark.createDataFrame([(f"s{i}", Vectors.sparse(5, [i % 5], [1.0])) for i in range(40)], ["session_id", "features"])
    b = spark.createDataFrame([(f"s{i}", i * 1.0) for i in range(40)], ["session_id", "score"])
    names = [f"t_{uuid.uuid4().hex}" for _ in "ab"]
    left, right = (write_keyed(x, n, scratch_path(spark, "keyed"), buckets=4) for x, n in zip((a, b), names, strict=True))
    joined = left.hint("merge").join(right, "session_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    rows = {r.session_id: r for r in joined.collect()}
    assert len(rows) == 40 and rows["s7"].features == Vectors.sparse(5, [2], [1.0]) and rows["s7"].score == 7.0
    b.write.option("path", scratch_path(spark, "plain")).saveAsTable(f"{names[0]}_plain")
    with pytest.raises(ValueError, match="isn't bucketed"):
        read_keyed(spark, f"{names[0]}_plain")
    for n in (*names, f"{names[0]}_plain"):
        spark.sql(f"DROP TABLE {n}")


def test_a_join_that_loses_rows_is_an_error(spark):
    def frame(keys):
        return spark.createDataFrame([(k, 1) for k in keys], "session_id string, x int").withColumnRenamed("x", f"x{uuid.uuid4().hex[:6]}")

    for hint in ("broadcast", "merge"):
        out, check = zip_by_key([frame("abc"), frame("cab").hint(hint), frame("bca")])
        assert stored(out, "zip").count() == 3 and check() == 3
        for bad in ("ab", "abcd", "abcc"):
            out, check = zip_by_key([frame("abc"), frame(bad).hint(hint)])
            stored(out, "zip")
            with pytest.raises(ValueError, match="session_id"):
                check()


def test_dirty_csv(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write(' Session_ID ,POS, Message\na,1,"x, y"\nb,one,z\nc,3\nd,4,w,extra\ne,,null pos\n')
    kept, rejected = R.read_csv_checked(spark, tmpdir_path, "` Session_ID ` string, `POS` long, ` Message` string")
    assert kept.columns == ["session_id", "pos", "message"]
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 1, "x, y"), ("e", None, "null pos")]
    assert sorted(r[0] for r in rejected.collect()) == ["b,one,z", "c,3", "d,4,w,extra"]


def test_gone_hosts_leave_the_gauge(spark, tmpdir_path):
    src, target = f"{tmpdir_path}/scores", f"{tmpdir_path}/gauge"
    os.makedirs(src)
    day = pd.Timestamp("2024-01-10")
    steps = [[("h1", 0, 1.0), ("h2", 0, 5.0)], [("h1", 30, 3.0)], [("h1", 90, 2.0)], [("h3", 200, 1.0)], [("h3", 201, None)], [("h2", 400, 0.5)]]
    for i, rows in enumerate(steps):
        frame = pd.DataFrame([(h, "s", day + pd.Timedelta(minutes=m), v) for h, m, v in rows], columns=["host", "service", "ts", "anomaly_score"])
        frame.to_parquet(f"{src}/{i}.parquet", index=False, coerce_timestamps="us")
    schema = "host string, service string, ts timestamp, anomaly_score double"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = L.start_upsert_stream(L.expiring_gauge_stream(stream, "ts", 3600), target, "host_service", "g", checkpoint=f"{tmpdir_path}/ck", gone="gone",
                                  transform=lambda b: b.withColumn("host_service", F.concat_ws("/", "host", "service")))
        q.awaitTermination()
        return {r.host: r.anomaly_score for r in UP.read_latest(spark, target).collect()}

    # after 400 minutes h1 and h3 are gone; h2 has come back, without its old maximum
    assert run() == {"h2": 0.5} and run() == {"h2": 0.5}
    assert "gone" not in UP.read_latest(spark, target).columns


def test_a_stream_leaves_no_copies_of_its_batches(spark, tmpdir_path):
    target = f"{tmpdir_path}/t"
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    batch = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "session_id string, x double")
    before = None
    for i in range(6):
        UP.upsert(spark, target, batch.withColumn("x", F.col("x") + i))
        now = len(os.listdir(folder))
        assert before is None or now == before
        before = now
    kept = stored(batch, "kept")
    discard(kept)
    assert len(os.listdir(folder)) == before


def test_a_key_may_leave_an_upserted_table(spark, tmpdir_path):
    rows = spark.createDataFrame([("a", 1, False), ("b", 2, False)], "session_id string, x int, gone boolean")
    UP.upsert(spark, f"{tmpdir_path}/t", rows, gone="gone")
    UP.upsert(spark, f"{tmpdir_path}/t", rows.where("x = 1").withColumn("gone", F.lit(True)), gone="gone")
    assert [tuple(r) for r in UP.read_latest(spark, f"{tmpdir_path}/t").collect()] == [("b", 2)]
    UP.upsert(spark, f"{tmpdir_path}/t", rows.where("x = 2").withColumn("gone", F.lit(True)), gone="gone")
    assert UP.read_latest(spark, f"{tmpdir_path}/t") is None
