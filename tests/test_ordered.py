"""Distributed ordering primitives against numpy/pandas brute force, with the
multi-bucket path forced (n_buckets > 1) as it runs at scale."""

import numpy as np
import pandas as pd
import pytest

from sessionlens.operators.ordered import (average_rank_pct, exact_quantiles, row_index, running_totals)

VALUES = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, None, 8.0, 9.0, 7.0, 9.0, 3.0, float("nan")]


@pytest.mark.parametrize("buckets", [None, 1, 3, 7])
def test_exact_quantiles(spark, buckets):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    probs = [0.0, 0.1, 0.5, 0.8, 0.995, 1.0]
    got = {r.prob: r.value for r in exact_quantiles(df, "x", probs, n_buckets=buckets).collect()}
    arr = np.array([v for v in VALUES if v is not None and not np.isnan(v)])
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(arr, p)), abs=1e-12)


@pytest.mark.parametrize("buckets", [None, 4])
def test_grouped_quantiles(spark, buckets):
    rows = [("a", float(i)) for i in range(11)] + [("b", float(i * i)) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, "x", [0.8], n_buckets=buckets, group_cols=["g"]).collect()}
    assert got[("a", 0.8)] == pytest.approx(np.quantile(np.arange(11.0), 0.8))
    assert got[("b", 0.8)] == pytest.approx(np.quantile(np.arange(7.0) ** 2, 0.8))


@pytest.mark.parametrize("buckets", [None, 3])
def test_average_rank_matches_pandas(spark, buckets):
    pdf = pd.DataFrame({"k": range(len(VALUES)), "x": VALUES, "y": [v if i % 3 else None for i, v in enumerate(VALUES)]})
    df = spark.createDataFrame(pdf.astype({"x": "float64", "y": "float64"}))
    out = average_rank_pct(df, ["x", "y"], "p_", n_buckets=buckets).toPandas().sort_values("k")
    exp_x = pdf["x"].rank(pct=True).to_numpy()
    exp_y = pdf["y"].rank(pct=True).to_numpy()
    np.testing.assert_allclose(out["p_x"].to_numpy(dtype=float), exp_x, equal_nan=True)
    np.testing.assert_allclose(out["p_y"].to_numpy(dtype=float), exp_y, equal_nan=True)


@pytest.mark.parametrize("buckets", [1, 5])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, buckets, descending):
    raw = [(float(i % 17), i % 3, 1) for i in range(200)]
    pdf = pd.DataFrame(raw, columns=["v", "g", "one"]).groupby(["v", "g"], as_index=False)["one"].sum() \
        .rename(columns={"one": "c"})
    df = spark.createDataFrame(pdf)
    got = {(r.g, r.v): r.cum_c for r in running_totals(df, "v", ["c"], group_cols=["g"], n_buckets=buckets,
                                                       descending=descending).collect()}
    exp = {}
    for g, part in pdf.groupby("g"):
        part = part.sort_values("v", ascending=not descending)
        for v, cum in zip(part["v"], part["c"].cumsum()):
            exp[(g, v)] = cum
    assert got == exp


def test_row_index_contiguous_and_ordered(spark):
    rows = [(i % 5, f"s{i:03d}") for i in range(97)]
    df = spark.createDataFrame(rows, "t int, s string")
    out = row_index(df, ["t", "s"], n_parts=6).orderBy("row_idx").collect()
    assert [r.row_idx for r in out] == list(range(97))
    assert [(r.t, r.s) for r in out] == sorted(rows)


@pytest.mark.parametrize("buckets", [None, 3])
def test_grouped_positions_equal_row_index(spark, buckets):
    _same_positions(spark, [5, 1, 9, 3], "long", buckets)


def test_grouped_positions_of_paths_and_large_ids(spark):
    _same_positions(spark, ["/data/log/b", "/data/log/a", "/data/log/ab", "/data/log/"], "string", 3)
    _same_positions(spark, [2 ** 60 + 1, 2 ** 60, 2 ** 60 + 3, 2 ** 60 + 2], "long", 3)


def _same_positions(spark, groups, kind, buckets):
    from sessionlens.operators.ordered import grouped_positions
    rows = [(g, i) for g, n in zip(groups, (40, 3, 1, 7)) for i in range(n)]  # the first is the hot group
    df = spark.createDataFrame(rows, f"g {kind}, i long")
    a = {(r.g, r.i): r.pos for r in grouped_positions(df, "g", "i", n_buckets=buckets).collect()}
    b = {(r.g, r.i): r.pos for r in row_index(df, ["g", "i"], "pos", n_parts=4).collect()}
    assert a == b


def test_null_order_values_come_first(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (1, 4)], "v long, c long")
    got = {r.v: r.cum_c for r in running_totals(df, "v", ["c"]).collect()}
    assert got == {None: 1, 1: 5, 3: 7}


def test_a_quantile_reads_its_input_once(spark, tmpdir_path):
    path = f"{tmpdir_path}/in"
    spark.range(1000).selectExpr("id * 1.0 AS x").write.parquet(path)
    seen = spark.sparkContext.accumulator(0)
    df = spark.read.parquet(path).mapInPandas(_counting(seen), "x double")
    assert exact_quantiles(df, "x", [0.5]).collect()[0].value == 499.5
    assert seen.value == 1000


def _counting(seen):
    def run(frames):
        for f in frames:
            seen.add(len(f))
            yield f.astype(float)
    return run


def test_positions_over_text_files(spark, tmpdir_path):
    from sessionlens.operators.ordered import file_positions
    from sessionlens.sources.readers import read_text_lines
    import os
    os.makedirs(f"{tmpdir_path}/logs")
    want = []
    for f, n in (("b", 500), ("a", 3), ("a1", 1), ("c", 0)):
        with open(f"{tmpdir_path}/logs/{f}.log", "w") as out:
            out.writelines(f"{f} {i} {'x' * 50}\n" for i in range(n))
    for f in ("a", "a1", "b"):
        want += open(f"{tmpdir_path}/logs/{f}.log").read().splitlines()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = read_text_lines(spark, f"{tmpdir_path}/logs/*.log")
        assert lines.rdd.getNumPartitions() > 4
        got = {r.pos: r.value for r in file_positions(lines, n_buckets=3).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[i] for i in range(len(want))] == want
