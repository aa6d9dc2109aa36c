"""Model checks by bound and by rule (never exact scores)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import evaluation as EV
from sessionlens.operators import models as M
from sessionlens.operators.boosting import Boosting
from sessionlens.plans import catalog as C
from sessionlens.plans.detector import Detectors

from .conftest import SF_CHECK


def test_stratified_fold_sizes(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "t long, label int").withColumn("sid", F.col("t").cast("string"))
    f = M.stratified_folds(df, "t", "sid").collect()
    labels = np.array(sorted(r.label for r in f))
    for c in (0, 1):
        sizes = [sum(1 for r in f if r.label == c and r.fold == i) for i in range(5)]
        idx = np.flatnonzero(labels == c)
        assert sizes == [int(((idx % 5) == i).sum()) for i in range(5)]
        folds = [r.fold for r in sorted(f, key=lambda r: r.t) if r.label == c]
        assert folds == sorted(folds)          # contiguous blocks in time order


def test_detectors_learn_planted_signal_and_roundtrip(spark, tmpdir_path):
    """The driver embeddings carry almost no label signal, so the fixture plants one:
    positives are shifted along the first two dimensions."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from sessionlens.plans.detector import train_detectors
    base = C.embedding_features(spark, SF_CHECK)
    arr = vector_to_array("features")
    shifted = F.transform(arr, lambda x, i: F.when((F.col("label") == 1) & (i < 2), x + 1.0).otherwise(x))
    feats = base.withColumn("features", array_to_vector(shifted))
    det, val = train_detectors(feats, "timestamp", "session_id", svd_k=16, bottleneck=4, trees=Boosting(rounds=5, leaves=8))
    p = EV.summary(val, "p_score_iso", "label").collect()[0]
    s = EV.summary(val, "fusion_score", "label").collect()[0]
    assert p.roc_auc > 0.9
    assert s.roc_auc > 0.9
    det.save(tmpdir_path)
    det2 = Detectors.load(tmpdir_path)
    a = {r.session_id: r.fusion_score for r in det.score(feats).collect()}
    b = {r.session_id: r.fusion_score for r in det2.score(feats).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_stacker_requires_inputs(spark):
    with pytest.raises(ValueError):
        M.choose_stacker_inputs(["p_primary"])
    assert M.choose_stacker_inputs(["p_primary", "z_ae"]) == ["p_primary", "z_ae"]
    assert M.choose_stacker_inputs(["p_primary", "z_out", "z_lat", "z_ae"]) == ["p_primary", "z_out", "z_lat"]


def test_svd_matches_numpy(spark):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + 0.3
    df = spark.createDataFrame([(i, Vectors.dense(r.tolist())) for i, r in enumerate(X)], ["i", "features"]) \
        .repartition(4)
    m = M.fit_svd(df, 3)
    _, sv, vt = np.linalg.svd(X, full_matrices=False)
    V = vt[:3].T
    # same subspace: projector difference vanishes
    assert np.allclose(m.V @ m.V.T, V @ V.T, atol=1e-8)
    Z = X @ V
    assert m.evr == pytest.approx(Z.var(axis=0).sum() / X.var(axis=0).sum(), rel=1e-9)
    out = np.array([r.svd for r in m.transform(df, "features", "svd").orderBy("i").collect()])
    assert np.allclose(np.abs(out), np.abs(X @ m.V), atol=1e-9)


def test_svd_of_sparse_and_dense_rows(spark):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(6)
    X = rng.normal(size=(80, 30)) * (rng.random((80, 30)) < 0.2) @ np.diag(np.linspace(3, 0.1, 30))
    X[7] = 0
    rows = [(i, Vectors.dense(r.tolist()) if i % 3 == 0 else Vectors.sparse(30, np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(X)]
    df = spark.createDataFrame(rows, ["i", "features"]).repartition(3)
    m = M.fit_svd(df, 4, n_iter=12, oversample=8)
    _, sv, _ = np.linalg.svd(X, full_matrices=False)
    assert np.allclose(np.linalg.norm(X @ m.V, axis=0), sv[:4], rtol=1e-3)
    out = np.array([r.svd for r in m.transform(df, "features", "svd").orderBy("i").collect()])
    assert np.allclose(out, X @ m.V, atol=1e-9)


def test_benign_sample(spark):
    rows = [(f"s{i:04d}", 0 if i % 4 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "session_id string, label int")
    got = sorted(r.session_id for r in M.benign_sample(df, cap=50).collect())
    h = df.where("label = 0").selectExpr("session_id", "xxhash64(session_id, 42) AS h").collect()
    assert got == sorted(r.session_id for r in sorted(h, key=lambda r: (r.h, r.session_id))[:50])
    assert M.benign_sample(df, cap=1000).count() == 300


def test_the_cap_holds_for_the_svd_only(spark):
    from pyspark.ml.linalg import Vectors
    from sessionlens.plans.detector import train_detectors
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6))
    x[::10] += 4
    rows = [(f"s{i:03d}", i, int(i % 10 == 0), Vectors.dense(x[i])) for i in range(400)]
    df = spark.createDataFrame(rows, ["session_id", "timestamp", "label", "features"])
    det, _ = train_detectors(df, svd_k=None, bottleneck=2, trees=Boosting(rounds=2, leaves=4), folds=2, benign_cap=30, min_val_rows=1, min_val_pos=1)
    benign = np.array([v for i, v in enumerate(x) if i % 10 and i < det.cut_us])
    assert len(benign) > 200
    assert np.allclose(det.scaler.mean, benign.mean(0)) and np.allclose(det.scaler.std, benign.std(0))
    code = ((benign - benign.mean(0)) / benign.std(0)) @ det.ae.P
    assert np.allclose(det.ae.code_stats.std, code.std(0), atol=1e-6)
