"""Batch = stream equality for the streaming operators (file source, availableNow)."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import sessions as S
from sessionlens.sources import upsert as UP
from sessionlens.streaming import live as L

from .conftest import SF_SMALL

SCHEMA = "session_id string, ts timestamp_ntz, event_type string, value double, event_id long"


def _events_pdf(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    return ev.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
                     "event_type", "value", "event_id").toPandas()


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_session_stream_equals_batch(spark, tmpdir_path):
    pdf = _events_pdf(spark)
    src = os.path.join(tmpdir_path, "src")
    os.makedirs(src)
    pdf.to_parquet(os.path.join(src, "001.parquet"), index=False, coerce_timestamps="us")
    # a later event on another key moves the watermark past every real session
    sentinel = pd.DataFrame({"session_id": ["~sentinel"], "ts": [pd.Timestamp("2030-01-01")],
                             "event_type": ["view"], "value": [0.0], "event_id": [-1]})
    sentinel.to_parquet(os.path.join(src, "002.parquet"), index=False, coerce_timestamps="us")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(L.session_stream(stream, "session_id", "ts", "6 hours", "1 hour"), "sess_stream")
    got = sorted((r.session_id, r.window_start, r.n_events) for r in out.collect() if r.session_id != "~sentinel")
    batch = spark.createDataFrame(pdf)
    exp = sorted((r.session_id, r.window_start, r.n_events) for r in
                 S.gap_sessions(batch, "session_id", "ts", 6 * 3600).collect())
    assert got == exp


def test_parse_and_dedupe_stream(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "txt")
    os.makedirs(src)
    with open(os.path.join(src, "a.log"), "w") as f:
        f.write("INFO blk_1 served 10.0.0.1\nno key\nWARN BLK_-2 lost 12345678\n")
    out = _run(L.parse_stream(spark.readStream.text(src)), "parsed").collect()
    assert sorted((r.session_id, r.log_key) for r in out) == [
        ("blk_-2", "warn blk_-<num> lost <hex>"), ("blk_1", "info blk_1 served <ip>")]
    pdf = _events_pdf(spark)
    dsrc = os.path.join(tmpdir_path, "dup")
    os.makedirs(dsrc)
    pd.concat([pdf, pdf.head(100)]).to_parquet(os.path.join(dsrc, "x.parquet"), index=False, coerce_timestamps="us")
    dstream = spark.readStream.schema(SCHEMA).parquet(dsrc).withColumn("ts", F.col("ts").cast("timestamp"))
    dd = _run(L.dedupe_stream(dstream, "ts", ["event_id"], "1 day"), "dd")
    assert dd.count() == len(pdf)


def test_gauge_upsert_stream(spark, tmpdir_path):
    pdf = pd.DataFrame({"host": ["h1", "h1", "h2"], "service": ["s", "s", "s"], "anomaly_score": [0.1, 0.7, 0.3]})
    src = os.path.join(tmpdir_path, "g")
    os.makedirs(src)
    pdf.to_parquet(os.path.join(src, "a.parquet"), index=False)
    target = os.path.join(tmpdir_path, "gauge")
    stream = spark.readStream.schema("host string, service string, anomaly_score double").parquet(src)
    q = L.start_upsert_stream(L.gauge_stream(stream), target, "host_service", "gauge_t",
                              checkpoint=os.path.join(tmpdir_path, "ck"), transform=lambda b: b.withColumn("host_service", F.concat_ws("/", "host", "service")))
    q.awaitTermination()
    got = {r.host_service: r.anomaly_score for r in UP.read_latest(spark, target).collect()}
    assert got == {"h1/s": 0.7, "h2/s": 0.3}


def test_a_restarted_stream_goes_on(spark, tmpdir_path):
    src, seen = os.path.join(tmpdir_path, "r"), []
    os.makedirs(src)
    for i in range(2):
        pd.DataFrame({"host": [f"h{i}"], "service": ["s"], "anomaly_score": [0.1]}).to_parquet(f"{src}/{i}.parquet", index=False)
        stream = spark.readStream.schema("host string, service string, anomaly_score double").parquet(src)
        q = L.start_upsert_stream(stream, f"file://{tmpdir_path}/rt", "host", "again", "append", os.path.join(tmpdir_path, "rck"),
                                  transform=lambda b: seen.append(b.count()) or b)
        q.awaitTermination()
    assert sum(seen) == 2 and UP.read_latest(spark, f"file://{tmpdir_path}/rt").count() == 2
    assert L._ckpt(spark, "x", None).endswith("/stream-x") if spark.conf.get("spark.checkpoint.dir", None) else pytest.raises(ValueError, L._ckpt, spark, "x", None)


def test_late_rows_are_dropped(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "late")
    os.makedirs(src)
    day = pd.Timestamp("2024-01-10")
    for i, ts in enumerate([day, day + pd.Timedelta("2D"), day - pd.Timedelta("3D"), day + pd.Timedelta("2D")]):
        pd.DataFrame({"id": [min(i, 1 if i == 3 else i)], "ts": [ts]}).to_parquet(f"{src}/{i}.parquet", index=False, coerce_timestamps="us")
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    out = _run(L.dedupe_stream(stream, "ts", ["id"], "1 hour"), "late_rows")
    assert sorted(r.id for r in out.collect()) == [0, 1]  # 2 is late, the second 1 a repeat


def test_score_stream_upserts_alert_rows(spark, tmpdir_path):
    """ST5: saved detectors applied to a stream of feature rows, upserted per batch;
    the table equals batch scoring."""
    from pyspark.ml.functions import array_to_vector

    from sessionlens.operators.boosting import Boosting
    from sessionlens.plans import catalog as C
    from sessionlens.plans.detector import train_detectors
    feats = C.embedding_features(spark, SF_SMALL)
    det, _ = train_detectors(feats, "timestamp", "session_id", svd_k=8, bottleneck=4, trees=Boosting(rounds=2, leaves=4),
                             folds=2, min_val_rows=1, min_val_pos=1)
    src = os.path.join(tmpdir_path, "feat")
    os.makedirs(src)
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").toPandas()
    e.to_parquet(os.path.join(src, "a.parquet"), index=False)
    stream = spark.readStream.schema("vec_id long, embedding array<double>, label int").parquet(src)
    fs = stream.select(F.col("vec_id").cast("string").alias("session_id"), F.col("vec_id").alias("timestamp"),
                       (F.col("label") == 0).cast("int").alias("label"),
                       array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    target = os.path.join(tmpdir_path, "alerts")
    det.save(f"file://{tmpdir_path}/model")
    det = type(det).load(f"file://{tmpdir_path}/model")
    q = L.start_upsert_stream(L.score_stream(fs, det).drop("z_out", "z_lat"), target, "session_id", "score_t",
                              output_mode="append", checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination()
    got = {r.session_id: r.fusion_score for r in UP.read_latest(spark, target).collect()}
    exp = {r.session_id: r.fusion_score for r in det.score(feats).collect()}
    assert got.keys() == exp.keys()
    assert all(abs(got[k] - exp[k]) < 1e-9 for k in exp)


def test_alert_rate_stream_equals_batch(spark, tmpdir_path):
    """ST4: tumbling-window alert rate per service on a stream equals the batch twin."""
    pdf = _events_pdf(spark)
    src = os.path.join(tmpdir_path, "ar")
    os.makedirs(src)
    pdf.to_parquet(os.path.join(src, "001.parquet"), index=False, coerce_timestamps="us")
    sentinel = pd.DataFrame({"session_id": ["~s"], "ts": [pd.Timestamp("2030-01-01")], "event_type": ["~none"],
                             "value": [0.0], "event_id": [-1]})
    sentinel.to_parquet(os.path.join(src, "002.parquet"), index=False, coerce_timestamps="us")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src) \
        .select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("service"),
                (F.col("value") > 150.0).cast("int").alias("is_alert"))
    out = _run(L.alert_rate_stream(stream), "alert_rate")
    got = sorted((r.window_start, r.service, round(r.alert_rate, 9), r.n) for r in out.collect() if r.service != "~none")
    b = spark.createDataFrame(pdf).select(F.col("ts").alias("timestamp"), F.col("event_type").alias("service"),
                                          (F.col("value") > 150.0).cast("int").alias("is_alert"))
    g = b.groupBy(F.window("timestamp", "1 hour").alias("w"), "service") \
        .agg(F.avg(F.col("is_alert").cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    exp = sorted((r.w.start, r.service, round(r.r, 9), r.n) for r in g.collect())
    assert got == exp
