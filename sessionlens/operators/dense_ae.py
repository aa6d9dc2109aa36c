"""Dense autoencoder (L7 step 2) trained by parameter averaging.

Architecture d -> hidden -> bottleneck -> hidden -> d with ReLU, input Gaussian noise, batch
normalisation and dropout after each hidden layer, L2 on the hidden kernels and L1 activity penalty on
the code, MSE loss, Adam.

Training: the (benign) input rows are persisted once; every epoch is ONE Spark job:
each partition receives the current state (broadcast), runs a pass of local Adam
mini-batches over its training rows in numpy (Arrow batches via ``mapInPandas``), and
returns its state, row count and losses; the driver-side result is a tree reduction
(``treeAggregate``) of row-weighted sums, so no single task gathers the data. The state is the
weights, the running means and variances of the normalisation, and Adam's moments and step count, so
that an epoch goes on where the last one ended; with one partition that is training in one process.
(Synchronous mini-batches would need a barrier's allGather for each, which takes Spark a second.)
Validation rows (a seeded hash of the key, ~10%) give the loss for early stopping
(patience 7, best weights restored) and learning-rate halving (patience 3, floor 1e-5).
Scoring is a ``pandas_udf`` over Arrow batches with the broadcast weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# ---- fixed values (network settings of the source system) ----
HIDDEN = 256
NOISE_STD = 0.05
DROPOUT = 0.2
L2_KERNEL = 1e-5
L1_CODE = 1e-4
LEARNING_RATE = 1e-3
BATCH = 256
MAX_EPOCHS = 100
PATIENCE_STOP = 7
PATIENCE_LR = 3
LR_FACTOR = 0.5
MIN_LR = 1e-5
VAL_FRACTION = 0.1
# ---- end of fixed values ----
# defaults of the source's library
ADAM_B1, ADAM_B2, ADAM_EPS = 0.9, 0.999, 1e-7
NORM_MOMENTUM, NORM_EPS = 0.99, 1e-3

#: What gradients move; g and s scale and shift the normalised hidden layers.
_NAMES = ("W1", "b1", "g1", "s1", "W2", "b2", "W3", "b3", "g3", "s3", "W4", "b4")
#: Running means and variances of the hidden layers.
_STATS = ("m1", "v1", "m3", "v3")


def init_weights(d: int, hidden: int, k: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)

    def glorot(a, b):
        lim = np.sqrt(6.0 / (a + b))
        return rng.uniform(-lim, lim, size=(a, b))
    w = {"W1": glorot(d, hidden), "b1": np.zeros(hidden), "W2": glorot(hidden, k), "b2": np.zeros(k),
         "W3": glorot(k, hidden), "b3": np.zeros(hidden), "W4": glorot(hidden, d), "b4": np.zeros(d)}
    for i in "13":
        w |= {f"g{i}": np.ones(hidden), f"s{i}": np.zeros(hidden), f"m{i}": np.zeros(hidden), f"v{i}": np.ones(hidden)}
    return w


def flatten(w: dict, names: tuple = _NAMES) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in names])


def unflatten(v: np.ndarray, shapes: dict, names: tuple = _NAMES) -> dict:
    out, i = {}, 0
    for n in names:
        size = int(np.prod(shapes[n]))
        out[n] = v[i:i + size].reshape(shapes[n])
        i += size
    return out


def _normalised(w: dict, h: np.ndarray, i: str, train: bool):
    """(scaled and shifted, what the way back needs) of a hidden layer."""
    mean, var = (h.mean(0), h.var(0)) if train else (w[f"m{i}"], w[f"v{i}"])
    inv = 1.0 / np.sqrt(var + NORM_EPS)
    hat = (h - mean) * inv
    return w[f"g{i}"] * hat + w[f"s{i}"], (hat, inv, mean, var)


def _back(w: dict, g_out: np.ndarray, kept, i: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the layer's input, scale and shift."""
    hat, inv, _, _ = kept
    g_hat = g_out * w[f"g{i}"]
    return inv * (g_hat - g_hat.mean(0) - hat * (g_hat * hat).mean(0)), (g_out * hat).sum(0), g_out.sum(0)


def forward(w: dict, x: np.ndarray, rng=None, train: bool = False):
    relu = lambda a: np.maximum(a, 0.0)
    drop = lambda h: (rng.random(h.shape) >= DROPOUT) / (1 - DROPOUT) if train else 1.0
    xin = x + rng.normal(0.0, NOISE_STD, size=x.shape) if train else x
    a1 = xin @ w["W1"] + w["b1"]
    n1, k1 = _normalised(w, relu(a1), "1", train)
    m1 = drop(n1)
    h1d = n1 * m1
    a2 = h1d @ w["W2"] + w["b2"]
    z = relu(a2)
    a3 = z @ w["W3"] + w["b3"]
    n3, k3 = _normalised(w, relu(a3), "3", train)
    m3 = drop(n3)
    h3d = n3 * m3
    out = h3d @ w["W4"] + w["b4"]
    return out, (xin, a1, k1, m1, h1d, a2, z, a3, k3, m3, h3d)


def loss_and_grads(w: dict, x: np.ndarray, rng) -> tuple[float, dict]:
    """Loss and gradients of a mini-batch; ``stats`` among the gradients are its means and variances."""
    out, (xin, a1, k1, m1, h1d, a2, z, a3, k3, m3, h3d) = forward(w, x, rng, train=True)
    B, d = x.shape
    diff = out - x
    loss = float(np.mean(diff ** 2) + L2_KERNEL * (np.sum(w["W1"] ** 2) + np.sum(w["W3"] ** 2))
                 + L1_CODE * np.sum(np.abs(z)) / B)
    g_out = 2.0 * diff / (B * d)
    g = {"W4": h3d.T @ g_out, "b4": g_out.sum(0)}
    g_h3, g["g3"], g["s3"] = _back(w, (g_out @ w["W4"].T) * m3, k3, "3")
    g_h3 = g_h3 * (a3 > 0)
    g["W3"] = z.T @ g_h3 + 2 * L2_KERNEL * w["W3"]
    g["b3"] = g_h3.sum(0)
    g_z = g_h3 @ w["W3"].T + L1_CODE * np.sign(z) / B
    g_a2 = g_z * (a2 > 0)
    g["W2"] = h1d.T @ g_a2
    g["b2"] = g_a2.sum(0)
    g_h1, g["g1"], g["s1"] = _back(w, (g_a2 @ w["W2"].T) * m1, k1, "1")
    g_h1 = g_h1 * (a1 > 0)
    g["W1"] = xin.T @ g_h1 + 2 * L2_KERNEL * w["W1"]
    g["b1"] = g_h1.sum(0)
    g["stats"] = {"m1": k1[2], "v1": k1[3], "m3": k3[2], "v3": k3[3]}
    return loss, g


@dataclass
class State:
    """Weights with their running statistics, Adam's moments, and its steps so far."""

    w: dict
    m: dict
    v: dict
    t: float = 0.0

    @staticmethod
    def fresh(w: dict) -> State:
        return State(w, {n: np.zeros_like(w[n]) for n in _NAMES}, {n: np.zeros_like(w[n]) for n in _NAMES})

    def step(self, x: np.ndarray, rng, lr: float) -> float:
        """One Adam step on a mini-batch; returns its loss."""
        loss, g = loss_and_grads(self.w, x, rng)
        self.t += 1
        for n in _NAMES:
            self.m[n] = ADAM_B1 * self.m[n] + (1 - ADAM_B1) * g[n]
            self.v[n] = ADAM_B2 * self.v[n] + (1 - ADAM_B2) * g[n] ** 2
            self.w[n] = self.w[n] - lr * (self.m[n] / (1 - ADAM_B1 ** self.t)) / (np.sqrt(self.v[n] / (1 - ADAM_B2 ** self.t)) + ADAM_EPS)
        for n in _STATS:
            self.w[n] = NORM_MOMENTUM * self.w[n] + (1 - NORM_MOMENTUM) * g["stats"][n]
        return loss

    def packed(self) -> np.ndarray:
        return np.concatenate([flatten(self.w), flatten(self.w, _STATS), flatten(self.m), flatten(self.v), [self.t]])

    @staticmethod
    def unpacked(x: np.ndarray, shapes: dict) -> State:
        n = sum(int(np.prod(shapes[k])) for k in _NAMES)
        s = len(x) - 3 * n - 1
        w = unflatten(x[:n], shapes) | unflatten(x[n:n + s], shapes, _STATS)
        return State(w, unflatten(x[n + s:2 * n + s], shapes), unflatten(x[2 * n + s:-1], shapes), float(x[-1]))


def epoch_over(state: State, frames, lr: float, rng_of) -> tuple[int, float]:
    """An epoch's mini-batches over arrays of rows; (rows, sum of losses by row)."""
    n, total = 0, 0.0
    for x in frames:
        rng = rng_of(n)
        order = rng.permutation(len(x))
        for s in range(0, len(x), BATCH):
            xb = x[order[s:s + BATCH]]
            if len(xb) > 1:  # a single row has no variance to be normalised by
                total += state.step(xb, rng, lr) * len(xb)
        n += len(x)
    return n, total


def val_loss(w: dict, x: np.ndarray) -> float:
    out, _ = forward(w, x)
    return float(np.sum(np.mean((out - x) ** 2, axis=1)))


@dataclass
class DenseAE:
    weights: dict
    history: list

    def _udf(self, spark):
        wb = spark.sparkContext.broadcast({k: v.astype(np.float64) for k, v in self.weights.items()})
        schema = StructType([StructField("err_out", DoubleType()), StructField("code", ArrayType(DoubleType()))])

        @pandas_udf(schema)
        def run(col: pd.Series) -> pd.DataFrame:
            w = wb.value
            x = np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, w["W1"].shape[0]))
            out, cache = forward(w, x)
            err = np.mean((out - x) ** 2, axis=1)
            return pd.DataFrame({"err_out": err, "code": list(cache[6])})  # z
        return run

    def reconstruct(self, df: DataFrame, x: str) -> DataFrame:
        """err_out (mean squared reconstruction error) and _code per row, in inference mode."""
        r = self._udf(df.sparkSession)(F.col(x))
        return df.withColumn("_ae", r).withColumn("err_out", F.col("_ae.err_out")) \
            .withColumn("_code", F.col("_ae.code")).drop("_ae")


def _epoch_job(rows: DataFrame, x: str, state: np.ndarray, shapes: dict, lr: float, epoch: int, seed: int):
    """One Spark job: local Adam pass per partition, tree-summed row-weighted states."""
    held = rows.sparkSession.sparkContext.broadcast(state)  # four times the weights
    dim = state.size

    def train(frames):
        now, first = State.unpacked(held.value.copy(), shapes), State.unpacked(held.value, shapes)
        vl, vn, pid = 0.0, 0, 0

        def arrays():
            nonlocal vl, vn, pid
            for pdf in frames:
                if len(pdf) == 0:
                    continue
                X = np.stack([np.asarray(a, dtype=np.float64) for a in pdf[x]])
                isval = pdf["_val"].to_numpy().astype(bool)
                if isval.any():
                    vl += val_loss(first.w, X[isval])
                    vn += int(isval.sum())
                pid = int(pdf["_pid"].iloc[0])
                yield X[~isval]

        n, tl = epoch_over(now, arrays(), lr, lambda k: np.random.default_rng([seed, epoch, pid, k]))
        yield pd.DataFrame({"n": [n], "tl": [tl], "vl": [vl], "vn": [vn], "w": [list(now.packed() * n)]})

    parts = rows.mapInPandas(train, "n long, tl double, vl double, vn long, w array<double>")

    def seq(acc, r):
        return (acc[0] + r["n"], acc[1] + r["tl"], acc[2] + r["vl"], acc[3] + r["vn"],
                acc[4] + np.asarray(r["w"], dtype=np.float64))

    def comb(a, b):
        return tuple(x + y for x, y in zip(a, b))
    n, tl, vl, vn, wsum = parts.rdd.treeAggregate((0, 0.0, 0.0, 0, np.zeros(dim)), seq, comb, depth=2)
    held.unpersist()
    new = wsum / n if n else state
    return new, (tl / n if n else float("nan")), (vl / vn if vn else float("nan"))


def fit_dense_ae(df: DataFrame, x: str, key: str, bottleneck: int = 16, hidden: int = HIDDEN,
                 max_epochs: int = MAX_EPOCHS, seed: int = 42) -> DenseAE:
    """Train on rows of array column ``x``; ``key`` seeds the validation split."""
    from pyspark import StorageLevel
    d = len(df.select(x).first()[0])
    rows = df.select(F.col(x), (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) <
                                F.lit(int(VAL_FRACTION * 1000))).alias("_val")) \
        .withColumn("_pid", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    w = init_weights(d, hidden, bottleneck, seed)
    shapes = {k: v.shape for k, v in w.items()}
    cur = State.fresh(w).packed()
    lr, best, best_w, since_best, since_lr, hist = LEARNING_RATE, np.inf, cur, 0, 0, []
    for ep in range(max_epochs):
        new, tl, vl_prev = _epoch_job(rows, x, cur, shapes, lr, ep, seed)
        # the validation loss measured in this job belongs to the incoming weights
        hist.append({"epoch": ep, "train_loss": tl, "val_loss_prev": vl_prev, "lr": lr})
        if np.isfinite(vl_prev):
            if vl_prev < best - 1e-12:
                best, best_w, since_best, since_lr = vl_prev, cur, 0, 0
            else:
                since_best += 1
                since_lr += 1
                if since_lr >= PATIENCE_LR:
                    lr, since_lr = max(lr * LR_FACTOR, MIN_LR), 0
                if since_best >= PATIENCE_STOP:
                    break
        cur = new
    rows.unpersist()
    return DenseAE(State.unpacked(best_w if np.isfinite(best) else cur, shapes).w, hist)
