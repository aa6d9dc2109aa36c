"""Column helpers and score-table normalising on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import (backfill_key, coalesce_cast, duration_seconds, null_normalised_timestamp,
                                   parse_timestamp)
from sessionlens.operators import charts as CH


def test_backfill_and_casts(spark):
    a = backfill_key(spark.createDataFrame([("x",)], "session_id string"))
    b = backfill_key(spark.createDataFrame([("y",)], "block_id string"))
    assert a.collect()[0].block_id == "x" and b.collect()[0].session_id == "y"
    df = spark.createDataFrame([(None, "2024-01-01 00:00:01", "2024-01-01 00:00:03"), (5, "bad", None)],
                               "n int, s string, e string")
    rows = df.select(coalesce_cast("n", 0, "long").alias("n"),
                     parse_timestamp("s").alias("t"),
                     duration_seconds(F.col("s").try_cast("timestamp"), F.col("e").try_cast("timestamp")).alias("d"),
                     null_normalised_timestamp("e").alias("e2")).collect()
    assert [r.n for r in rows] == [0, 5]
    assert rows[0].t == dt.datetime(2024, 1, 1, 0, 0, 1) and rows[1].t is None
    assert rows[0].d == 2.0 and rows[1].d is None
    nat = spark.createDataFrame([("",), ("NaT",), (None,), ("2024-02-03 04:05:06",)], "t string")
    assert [r[0] for r in nat.select(null_normalised_timestamp("t")).collect()] == [
        None, None, None, dt.datetime(2024, 2, 3, 4, 5, 6)]


def test_alias_fold_keeps_first_spelling(spark):
    df = spark.createDataFrame([("a", 0.2, 0.9, 1)], "sid string, score double, prob double, y int")
    out = CH.normalize_aliases(df)
    assert out.columns == ["session_id", "anomaly_score", "prob", "label"]


def test_score_synthesis_skips_constant_and_propagates_null(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, 0.3), ("b", 3.0, 5.0, 0.1), ("c", None, 5.0, 0.2)],
                               "session_id string, recon_error double, dist_const double, other double")
    out = {r.session_id: r.anomaly_score for r in CH.synthesize_score(df).collect()}
    assert out == {"a": 0.0, "b": 1.0, "c": None}
    with pytest.raises(ValueError):
        CH.synthesize_score(spark.createDataFrame([("a", 1.0)], "session_id string, mse_c double"))


def test_p90_flag_nulls(spark):
    df = spark.createDataFrame([(f"s{i}", float(i)) for i in range(10)] + [("n", None)],
                               "session_id string, anomaly_score double")
    out = {r.session_id: r.pred for r in CH.percentile_flag(df).collect()}
    assert out["n"] is None
    assert sum(v for v in out.values() if v) == 1 and out["s9"] == 1


def test_export_charts_plan(spark):
    from sessionlens.plans.ensemble import export_charts, rank_scores
    a = spark.createDataFrame([(f"s{i}", float(i)) for i in range(12)], "session_id string, score_iso double")
    b = spark.createDataFrame([(f"s{i}", float(-i)) for i in range(0, 12, 2)], "session_id string, score_ae double")
    ranked = rank_scores([a, b], ["score_iso", "score_ae"])
    events, sessions, gauge = export_charts(ranked, "2024-02-01 00:00:00", services=("hdfs", "yarn"))
    assert sessions.count() == 12
    assert events.count() == 12 * 6
    assert set(r.service for r in gauge.collect()) == {"hdfs", "yarn"}
    ev = events.where("session_id = 's3'").orderBy("timestamp").collect()
    steps = [(y.timestamp - x.timestamp).total_seconds() / 60 for x, y in zip(ev, ev[1:])]
    assert all(5 <= s <= 25 for s in steps)       # 15 minutes + difference of two jitters in [-5, 5]
