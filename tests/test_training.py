"""E1/E2 from raw lines: vectors without documents, one saved plan, columns wider than a block."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sessionlens.operators import boosting as B
from sessionlens.operators import models as M
from sessionlens.operators import tfidf as TF
from sessionlens.plans import stages as ST
from sessionlens.plans import training as TR
from sessionlens.plans.detector import Detectors


def lines(spark):
    rows = [("A ", 0, "Open file one"), ("a", 1, "open FILE two"), ("a", 2, ""), ("a", 3, "close"), ("b", 0, "open file"), ("b", 5000, "close é file"), ("c", 0, None), (None, 0, "lost"),
            ("d", 0, "open open open"), ("e", 1, "file two open file")]
    return spark.createDataFrame(rows, "session_id string, pos long, message string").repartition(3)


def sessions(spark):
    rows = [(k, i, int(k in "ad"), float(i)) for i, k in enumerate("abcdef")]
    return spark.createDataFrame(rows, "session_id string, timestamp long, label int, x double").withColumns({"timestamp_start": F.timestamp_seconds("timestamp"), "timestamp_end": F.timestamp_seconds(F.col("timestamp") * 3)})


def test_vectors_equal_the_relational_form(spark):
    t = TR.session_table(sessions(spark), lines(spark), "session_id", ["pos"])
    assert "doc" not in t.sessions.columns
    fit = t.sessions.where("session_id <> 'e'")
    vec = TF.fit_vectoriser(t.terms, fit, min_df=1)
    got = {r.session_id: r for r in vec.transform(t.sessions, t.terms).collect()}
    assert set(got) == set("abcdef")
    own = lines(spark).withColumn("session_id", F.lower(F.trim("session_id")))
    want = TF.relational_tfidf(own, "session_id", "pos", "message", n_docs=fit.count(), fit_keys=fit, min_df=1).collect()
    place = {r.term: r.term_idx for r in vec.terms.collect()}
    for k, r in got.items():
        x = r.features.toArray()
        assert len(x) == vec.size + 2 and tuple(x[-2:]) == (r.n_events, r.duration_sec)
        full = {place[w.term]: w.weight for w in want if w.session_id == k}
        assert np.allclose(x[:-2], [full.get(i, 0.0) for i in range(vec.size)])
    assert got["f"].n_events == 0 and got["a"].n_events == 4 and not got["c"].features.toArray()[:-2].any()
    counts = {r.term_idx: r.term for r in vec.terms.collect()}
    assert counts[0] == "open"  # the most frequent comes first


def test_ties_of_a_position_are_put_in_order(spark):
    rows = [("a", 1, 2, "second"), ("a", 1, 1, "first"), ("a", 2, 0, "third")]
    df = spark.createDataFrame(rows, "k string, pos long, tie long, text string")
    got = {r.term for r in TF.line_terms(df, "k", "pos", "text", ties=["tie"]).collect()}
    assert {"first second", "second third"} <= got and "second first" not in got


@pytest.fixture(scope="module")
def planted(spark):
    """300 sessions of lines; those that hold "fault code" are positive."""
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    rows, table = [], []
    for i in range(300):
        bad = int(r.random() < 0.3)
        for p in range(4):
            text = " ".join(r.choice(words, 5)) + (" fault code" if bad and p == 2 else "")
            rows.append((f"s{i}", p, text))
        table.append((f"s{i}", i, bad))
    return (spark.createDataFrame(table, "session_id string, timestamp long, label int"), spark.createDataFrame(rows, "session_id string, pos long, message string"))


@pytest.mark.parametrize("kind", ["linear", "dense"])
def test_a_saved_plan_scores_alike(spark, planted, tmpdir_path, kind):
    t = TR.session_table(*planted, "session_id", ["pos"])
    trees = B.Boosting(rounds=6, step=0.3, leaves=6, min_rows=5)
    model, val = TR.train_from_logs(t, svd_k=6, bottleneck=2, trees=trees, folds=2, min_val_rows=1, min_val_pos=1, ae_kind=kind, ae_hidden=8, ae_epochs=2)
    auc = val.agg(F.avg(F.when(F.col("label") == 1, F.col("p_score_iso"))).alias("p"), F.avg(F.when(F.col("label") == 0, F.col("p_score_iso"))).alias("n")).first()
    assert auc.p > 0.8 and auc.n < 0.2  # the trees read the terms themselves
    path = f"file://{tmpdir_path}/model"
    model.save(path)
    back = TR.LogModel.load(spark, path)
    a, b = ({r.session_id: (r.p_score_iso, r.z_ae, r.fusion_score, r.is_alert) for r in m.score(t).collect()} for m in (model, back))
    assert len(a) == 300 and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)
    plan = PipelineModel.load(f"{path}/plan")
    assert [type(s).__name__ for s in plan.stages] == ["TreesStage", "ReduceStage", "ChannelsStage", "StackStage"]
    direct = {r.session_id: r.fusion_score for r in plan.transform(back.features(t)).select("session_id", "fusion_score").collect()}
    assert all(direct[k] == pytest.approx(a[k][2], abs=1e-12) for k in a)


def test_what_is_missing_is_named(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        TR.LogModel.load(spark, f"file://{tmpdir_path}")
    with pytest.raises(FileNotFoundError, match="metadata"):
        Detectors.load(f"file://{tmpdir_path}")


def test_matrices_are_saved_in_rows(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(ST, "SLICE", 10)
    x = np.random.default_rng(1).normal(size=(23, 4))
    ST.save_rows(spark, x, f"{tmpdir_path}/m")
    assert np.array_equal(ST.load_rows(spark, f"{tmpdir_path}/m"), x) and spark.read.parquet(f"{tmpdir_path}/m").count() == 23


def test_svd_in_blocks_of_columns(spark, monkeypatch):
    r = np.random.default_rng(8)
    X = r.normal(size=(90, 40)) * (r.random((90, 40)) < 0.3) @ np.diag(np.linspace(4, 0.1, 40))
    df = spark.createDataFrame([(Vectors.sparse(40, np.flatnonzero(v).tolist(), v[v != 0].tolist()),) for v in X], ["features"]).repartition(3)
    whole = M.fit_svd(df, 9)
    monkeypatch.setattr(M, "SVD_BLOCK", 4)
    monkeypatch.setattr(M, "SVD_RANGE", 7)
    cut = M.fit_svd(df, 9)
    assert np.allclose(cut.V, whole.V, atol=1e-8) and cut.evr == pytest.approx(whole.evr, abs=1e-10)


def test_packed_cells_round_trip():
    x = np.arange(10, dtype=np.int32)
    cells = B.packed(x, np.array([0, 3, 3, 10]))
    values, begin = B.unpacked(cells, np.int32)
    assert list(values) == list(x) and list(begin) == [0, 3, 3, 10]
    values, begin = B.unpacked(cells.slice(1, 2), np.int32)
    assert list(values) == list(range(3, 10)) and list(begin) == [0, 0, 7]
    assert B.unpacked(pa.array([b"", b""], pa.binary()), np.int32)[1].tolist() == [0, 0, 0]
    assert json.dumps(B.Boosting().__dict__)  # settings are plain values


def test_a_stream_of_lines_gives_the_alerts_of_a_batch(spark, planted, tmpdir_path):
    """ST5: two runs of the stream from one checkpoint, sessions that span both."""
    import os

    import pandas as pd

    from sessionlens.operators import sessions as S
    from sessionlens.sources import upsert as UP
    from sessionlens.streaming import live as L
    table, lines = planted
    start = F.timestamp_seconds(F.substring("session_id", 2, 9).cast("long") * 60 + F.col("pos") * 5 + 1_700_000_000)
    timed = lines.withColumn("ts", start)
    sess = S.sessionize(timed, "session_id", "ts").join(table.select("session_id", "label"), "session_id")
    t = TR.session_table(sess, timed, "session_id", ["pos"])
    model, _ = TR.train_from_logs(t, svd_k=4, bottleneck=2, trees=B.Boosting(rounds=3, step=0.3, leaves=4, min_rows=5), folds=2, min_val_rows=1, min_val_pos=1)
    want = {r.session_id: r for r in model.score(t).collect()}
    src, target = f"{tmpdir_path}/lines", f"{tmpdir_path}/alerts"
    os.makedirs(src)
    frame = timed.toPandas().sort_values("ts").sample(frac=1, random_state=1).sort_values("ts", kind="stable")
    cuts = [frame.iloc[:501], frame.iloc[501:803], frame.iloc[803:], pd.DataFrame([("~end", 0, "x", pd.Timestamp("2030-01-01"))], columns=frame.columns)]

    def run(parts, first):
        for i, p in enumerate(parts):
            p.to_parquet(f"{src}/{first + i}.parquet", index=False, coerce_timestamps="us")
        stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(src)
        L.start_alert_stream(stream, model, target, "alerts", "session_id", "ts", "message", ["pos"], 600, "1 minute", checkpoint=f"{tmpdir_path}/ck").awaitTermination()
        return {r.session_id: r for r in UP.read_latest(spark, target).collect()}

    early = run(cuts[:1], 0)
    assert 0 < len(early) < 300
    got = run(cuts[1:], 1)
    assert set(got) == set(want)
    for k, r in got.items():
        assert (r.timestamp, r.is_alert) == (want[k].timestamp, want[k].is_alert)
        assert np.allclose([r.p_score_iso, r.z_ae, r.fusion_score], [want[k].p_score_iso, want[k].z_ae, want[k].fusion_score], atol=1e-9)
