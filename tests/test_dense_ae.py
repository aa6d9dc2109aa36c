"""Dense autoencoder: analytic gradients equal finite differences; training on benign
rows separates shifted rows by reconstruction error; weights survive save/load."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionlens.operators import dense_ae as D
from sessionlens.plans import catalog as C

from .conftest import SF_CHECK


def test_gradients_match_finite_differences():
    rng0 = np.random.default_rng(0)
    w = D.init_weights(5, 7, 3, seed=1)
    for n in ("b1", "b2", "b3", "s1", "s3"):  # zeros would lie on the kinks, where no slope is defined
        w[n] = rng0.normal(size=w[n].shape)
    x = rng0.normal(size=(4, 5))

    def loss_at(wv):
        loss, _ = D.loss_and_grads(D.unflatten(wv, {k: v.shape for k, v in w.items()}), x, np.random.default_rng(9))
        return loss
    _, g = D.loss_and_grads(w, x, np.random.default_rng(9))
    flat, gflat = D.flatten(w), D.flatten(g)
    idx = np.random.default_rng(3).choice(flat.size, 25, replace=False)
    for i in idx:
        e = np.zeros_like(flat)
        e[i] = 1e-6
        num = (loss_at(flat + e) - loss_at(flat - e)) / 2e-6
        assert abs(num - gflat[i]) < 1e-5 + 1e-3 * abs(num)


def test_dense_ae_flags_shifted_rows(spark):
    f = C.embedding_features(spark, SF_CHECK).withColumn("x", vector_to_array("features"))
    ae = D.fit_dense_ae(f.where("label = 0"), "x", "session_id", bottleneck=4, hidden=32, max_epochs=8)
    assert len(ae.history) >= 1
    shifted = f.withColumn("x", F.transform("x", lambda v, i: F.when(i < 8, v + 1.0).otherwise(v)))
    a = ae.reconstruct(f, "x").agg(F.avg("err_out")).collect()[0][0]
    b = ae.reconstruct(shifted, "x").agg(F.avg("err_out")).collect()[0][0]
    assert b > a * 2
    back = D.DenseAE({k: np.array(v.tolist()) for k, v in ae.weights.items()}, [])
    c = back.reconstruct(f, "x").agg(F.avg("err_out")).collect()[0][0]
    assert abs(a - c) < 1e-12


def test_one_partition_equals_one_process(spark):
    """State carries over epochs: weights, normalisation, moments and steps."""
    r = np.random.default_rng(5)
    X = r.normal(size=(700, 6)) @ r.normal(size=(6, 6))
    df = spark.createDataFrame([(f"s{i}", v.tolist()) for i, v in enumerate(X)], "session_id string, x array<double>").coalesce(1)
    flags = [b.v for b in df.selectExpr("pmod(xxhash64(session_id, 42), 1000) < 100 AS v").collect()]
    train, held = X[~np.array(flags)], X[np.array(flags)]
    ae = D.fit_dense_ae(df, "x", "session_id", bottleneck=2, hidden=9, max_epochs=4)
    state = D.State.fresh(D.init_weights(6, 9, 2, 42))
    losses, states = [], []
    for epoch in range(4):
        losses.append(D.val_loss(state.w, held) / len(held))
        states.append({k: v.copy() for k, v in state.w.items()})
        D.epoch_over(state, [train], D.LEARNING_RATE, lambda k, e=epoch: np.random.default_rng([42, e, 0, k]))
    assert np.allclose([h["val_loss_prev"] for h in ae.history], losses, rtol=1e-9)
    best = states[int(np.argmin(losses))]
    assert all(np.allclose(ae.weights[k], best[k], rtol=1e-9) for k in best) and state.t == 4 * -(-len(train) // D.BATCH)
    assert not np.allclose(best["m1"], 0) and not np.allclose(best["g1"], 1)


def test_normalisation_uses_running_statistics_when_scoring():
    w = D.init_weights(4, 5, 2, seed=3)
    x = np.random.default_rng(1).normal(size=(30, 4))
    one, _ = D.forward(w, x[:1])
    assert np.allclose(one, D.forward(w, x)[0][:1])  # a row's result doesn't hang on its batch
    w["m1"], w["v1"] = np.full(5, 0.5), np.full(5, 2.0)
    assert not np.allclose(one, D.forward(w, x)[0][:1])
