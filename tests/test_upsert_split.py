"""Keyed upsert semantics and the temporal split rules."""

import datetime as dt

import pytest

from sessionlens.operators import split as SP
from sessionlens.sources import upsert as UP


def _batch(spark, rows):
    return spark.createDataFrame(rows, "session_id string, timestamp string, p_score_iso double, z_ae double, "
                                       "fusion_score double, is_alert int, label int")


def test_upsert_insert_update_idempotent(spark, tmpdir_path):
    b1 = _batch(spark, [("a", "2024-01-01 00:00:00", 0.1, 1.0, 0.2, 0, 0), ("b", "", 0.5, 2.0, 0.6, 1, 1)])
    UP.upsert(spark, tmpdir_path, b1, "session_id", UP.ALERT_TYPES)
    b2 = _batch(spark, [("b", "NaT", 0.9, 3.0, 0.95, 1, 1), ("c", "2024-01-02 00:00:00", 0.0, 0.0, 0.0, 0, 0)])
    UP.upsert(spark, tmpdir_path, b2, "session_id", UP.ALERT_TYPES)
    UP.upsert(spark, tmpdir_path, b2, "session_id", UP.ALERT_TYPES)   # replay: same table
    t = {r.session_id: r for r in UP.read_latest(spark, tmpdir_path).collect()}
    assert set(t) == {"a", "b", "c"}
    assert t["b"].fusion_score == 0.95 and t["b"].timestamp is None
    assert t["a"].timestamp == dt.datetime(2024, 1, 1)


def test_a_uri_names_one_table_from_any_directory(spark, tmpdir_path, monkeypatch):
    import os
    uri = f"file://{tmpdir_path}/shared/table"
    for d, rows in (("one", [("a", "", 0.1, 1.0, 0.2, 0, 0), ("b", "", 0.5, 2.0, 0.6, 1, 1)]), ("two", [("c", "", 0.0, 0.0, 0.0, 0, 0)])):
        os.makedirs(f"{tmpdir_path}/{d}")
        monkeypatch.chdir(f"{tmpdir_path}/{d}")
        UP.upsert(spark, uri, _batch(spark, rows), "session_id", UP.ALERT_TYPES)
    assert {r.session_id for r in UP.read_latest(spark, uri).collect()} == {"a", "b", "c"}


def test_a_broken_write_is_finished(spark, tmpdir_path, monkeypatch):
    """A writer that ends before, or while, buckets are replaced."""
    from sessionlens.sources import storage as ST
    path = f"{tmpdir_path}/t"
    one = [("a", "", 0.1, 1.0, 0.2, 0, 0), ("b", "", 0.5, 2.0, 0.6, 1, 1)]
    UP.upsert(spark, path, _batch(spark, one), "session_id", UP.ALERT_TYPES, n_buckets=4)
    rows = lambda: {r.session_id: r.label for r in UP.read_latest(spark, path).collect()}
    with pytest.raises(Exception, match="(?i)divide|zero"):  # the job that makes the merged rows fails
        bad = _batch(spark, [("a", "", 0.1, 1.0, 0.2, 0, 9)]).selectExpr("*", "raise_error('divide by zero') AS x")
        UP.upsert(spark, path, bad)
    assert rows() == {"a": 0, "b": 1}
    finish = UP._finish
    with monkeypatch.context() as m:  # ends with the merged copy written, a bucket already deleted
        calls = []
        m.setattr(UP, "_finish", lambda *x: calls.append(x) or (finish(*x) if len(calls) == 1 else None))
        UP.upsert(spark, path, _batch(spark, [("a", "", 0.1, 1.0, 0.2, 0, 7), ("c", "", 0.1, 1.0, 0.2, 0, 3)]), "session_id", UP.ALERT_TYPES)
    for r in spark.read.parquet(f"{path}/_merged").select("bucket").distinct().collect():
        ST.remove(spark, f"{path}/bucket={r.bucket}")
    assert rows() == {"a": 7, "b": 1, "c": 3} and not ST.exists(spark, f"{path}/_merged")
    UP.upsert(spark, path, _batch(spark, [("d", "", 0.1, 1.0, 0.2, 0, 5)]), "session_id", UP.ALERT_TYPES, n_buckets=99)
    assert rows()["d"] == 5 and {p.rsplit("=", 1)[1].split("_")[0] for p in ST.matches(spark, f"{path}/bucket=*")} == {"4"}


def test_upsert_rejects_duplicate_keys(spark, tmpdir_path):
    b = _batch(spark, [("a", "", 0.1, 1.0, 0.2, 0, 0), ("a", "", 0.2, 1.0, 0.2, 0, 0)])
    with pytest.raises(ValueError):
        UP.upsert(spark, tmpdir_path, b, "session_id", UP.ALERT_TYPES)


def test_split_fallback_and_nulls(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"s{i}", t0 + dt.timedelta(days=i), 1 if i in (1, 2, 3, 4, 5) else 0) for i in range(20)]
    rows.append(("nul", None, 0))
    df = spark.createDataFrame(rows, "session_id string, timestamp timestamp, label int")
    d = SP.decide_cut(df, min_val_rows=1, min_val_pos=1, min_val_pos_frac=0.0)
    assert d.source == "positives"
    d2 = SP.decide_cut(df)                       # default minimums cannot be met -> all rows
    assert d2.source == "all"
    out = {r.session_id: r.split for r in SP.apply_split(df, d2.cut_us).collect()}
    assert out["nul"] is None
    assert sum(v == "val" for v in out.values()) == 4   # q0.8 of 20 daily points -> last 4 days (cut inside)
    rep = {r.split: r.rows for r in SP.split_report(SP.apply_split(df, d2.cut_us)).collect()}
    assert rep == {"train": 16, "val": 4}
