"""Sessions, labels, documents and TF-IDF terms: hand-written rows and chunking
invariance (a hot session split into many chunks gives the same answer)."""

import datetime as dt

import pandas as pd

from sessionlens.operators import sessions as S
from sessionlens.operators import tfidf as TF


def test_sessionize_drops_null_keys_and_counts(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0 + dt.timedelta(hours=1)), (None, t0), ("b", t0)]
    df = spark.createDataFrame(rows, "session_id string, timestamp timestamp")
    out = {r.session_id: r for r in S.sessionize(df).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"].n_events == 2 and out["b"].n_events == 1
    assert out["b"].timestamp_start == out["b"].timestamp_end


def test_labels_header_duplicates_and_replace(spark):
    raw = spark.createDataFrame([("BlockId", "Label"), ("blk_1", "Normal"), ("blk_1", "Anomaly"),
                                 (" BLK_2 ", "normal"), ("blk_3", "strange")], "block_id string, label string")
    lab = {r.block_id: r.label for r in S.label_table(raw).collect()}
    assert lab == {"blk_1": 1, "blk_2": 0, "blk_3": 0}
    sess = spark.createDataFrame([("blk_1", 0), ("blk_2", 1), ("blk_9", 1)], "session_id string, label int")
    out = {r.session_id: r.label for r in S.attach_labels(sess, S.label_table(raw)).collect()}
    assert out == {"blk_1": 1, "blk_2": 0, "blk_9": 0}


def test_documents_chunk_invariance(spark):
    rows = [("hot", i, f" line {i} ") for i in range(50)] + [("cold", 3, "x"), ("cold", 1, None)]
    df = spark.createDataFrame(rows, "k string, pos long, text string")
    a = {r.k: r.doc for r in S.session_documents(df, "k", ["pos"], "text", chunk_size=4096).collect()}
    b = {r.k: r.doc for r in S.session_documents(df, "k", ["pos"], "text", chunk_size=3).collect()}
    assert a == b
    assert a["hot"] == " ".join(f"line {i}" for i in range(50))
    assert a["cold"] == " x"


def test_line_terms_cross_lines_and_chunks(spark):
    rows = [("s", 0, "a b"), ("s", 1, "!!"), ("s", 2, "c"), ("s", 5, "d e"), ("t", 0, "z")]
    df = spark.createDataFrame(rows, "k string, pos long, text string")

    def terms(chunk):
        return sorted(r.term for r in TF.line_terms(df, "k", "pos", "text", chunk=chunk).where("k = 's'").collect())

    exp = sorted(["a", "b", "c", "d", "e", "a b", "b c", "c d", "d e"])
    assert terms(4096) == exp
    assert terms(1) == exp
    assert terms(2) == exp


def test_gap_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    offs = [0, 1, 2, 10, 11, 30, 31, 32, 33, 80]  # hours
    rows = [("u", t0 + dt.timedelta(hours=h)) for h in offs] + [("v", t0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    a = sorted((r.k, r.window_start, r.n_events) for r in S.gap_sessions(df, "k", "ts", 6 * 3600).collect())
    assert [x[2] for x in a if x[0] == "u"] == [3, 2, 4, 1]


def test_gap_sessions_with_equal_times(spark):
    import random
    r = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"u{i % 40}", t0 + dt.timedelta(minutes=r.choice([0, 1, 1, 7, 7, 30, 90, 91, 200]) + 300 * r.randint(0, 3))) for i in range(1200)]
    got = {(g.k, g.window_start, g.n_events) for g in S.gap_sessions(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 1800).collect()}
    want, last = [], {}
    for k, t in sorted(rows):
        if k in last and (t - last[k][0]).total_seconds() <= 1800:
            want[last[k][1]][2] += 1
        else:
            want.append([k, t, 1])
            last[k] = (t, len(want) - 1)
        last[k] = (t, last[k][1])
    assert got == {tuple(w) for w in want}


def test_spellings_of_a_key_are_one_session(spark):
    s = spark.createDataFrame([("blk_1",)], "session_id string")
    lines = spark.createDataFrame([("blk_1", 0, "a"), (" BLK_1 ", 1, "b")], "k string, pos long, t string")
    (row,) = S.session_features(s, lines, "k", ["pos"], "t").collect()
    assert (row.n_events, row.doc) == (2, "a b")


def test_a_limit_on_duplicates_keeps_defined_rows(spark):
    df = spark.createDataFrame([("a", i % 7) for i in range(50)], "session_id string, x int").repartition(5)
    assert [r.x for r in S.duplicate_sessions(df, 10).collect()] == [0] * 8 + [1] * 2


def test_profiles(spark):
    df = spark.createDataFrame([("a", "b1", 1), ("a", "b1", 0), ("c", "b2", 1)],
                               "session_id string, block_id string, label int")
    u = S.uniqueness_profile(df).collect()[0]
    assert (u.total_rows, u.unique_sessions, u.duplicate_rows) == (3, 2, 1)
    b = S.block_profile(df).collect()[0]
    assert (b.unique_blocks, b.max_sessions_per_block) == (2, 2)
    a = S.anomaly_profile(df).collect()[0]
    assert (a.anomaly_sessions, a.anomaly_blocks) == (2, 2)
    d = S.duplicate_sessions(df).collect()
    assert [r.session_id for r in d] == ["a", "a"]


def test_a_burst_within_one_hour_is_cut_by_number(spark):
    """Chunks in time order hold so many lines at most, however many share an hour or an instant."""
    from pyspark.sql import functions as F

    from sessionlens.operators import tfidf as TF
    n = 5000
    rows = spark.range(n).select(F.lit("s").alias("session_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 1000)).alias("ts"),
                                 F.col("id").alias("pos"), F.concat(F.lit("w"), F.col("id") % 7).alias("text")).repartition(5)
    r = S.session_documents(rows, "session_id", ["ts", "pos"], "text", chunk_size=64).collect()[0]
    want = [f"w{i % 7}" for i in range(n)]
    assert r.doc == " ".join(want) and r.n_events == n and (r.last_order - r.first_order).seconds == 4
    got = {x.term: x["count"] for x in TF.line_terms(rows, "session_id", "ts", "text", chunk=64, ties=["pos"]).groupBy("term").count().collect()}
    expect = {}
    for i, w in enumerate(want):
        for t in ([w] if not i else [w, f"{want[i - 1]} {w}"]):
            expect[t] = expect.get(t, 0) + 1
    assert got == expect
