"""Class weights (A17), boosted trees with stratified contiguous folds and isotonic
calibration (L1-L3), capped benign sample (L4), truncated SVD (L5), benign
standardisation (L6), logistic stacker (L12, L13, L16).

Features are ML vectors in column ``features``; labels are 0/1 ints. Every fit is a
distributed job; only model parameters (bounded by the feature count) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..session import small_side, stored
from .boosting import BoostedTrees, Boosting, _Scorer, fit_boosted, score_own, vector_rows
from .ordered import row_index

# ---- fixed values (settings of the source system; those of the trees are Boosting's defaults) ----
GBT_SEED = 42
N_FOLDS = 5
BENIGN_CAP = 120_000
SVD_ITER = 5
# ---- end of fixed values ----
#: Columns of the basis that a pass of the SVD multiplies with, and rows of a partial product in a record.
SVD_BLOCK, SVD_RANGE = 32, 8192


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """A17 as a weight column: positives get max(1, neg / max(1, pos)), negatives 1."""
    st = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).collect()[0]
    spw = max(1.0, st["n"] / max(1, st["p"]))
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(spw)).otherwise(F.lit(1.0)))


def stratified_folds(df: DataFrame, order: str, tiebreak: str, label: str = "label", k: int = N_FOLDS,
                     out: str = "fold") -> DataFrame:
    """L2: unshuffled stratified folds = contiguous blocks inside each class in ``order``.

    Block sizes follow the striding rule over the label-sorted rows (fold i gets the
    rows j = i, i+k, ... of that order), computed on the driver from class counts only.
    The in-class rank comes from one global row index (no window over a class or a timestamp).
    """
    counts = {r[label]: int(r["n"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    start, bounds = 0, {}
    for c in sorted(counts):
        n = counts[c]
        alloc = [len(range(start + ((i - start) % k), start + n, k)) for i in range(k)]
        cum = np.cumsum(alloc).tolist()
        bounds[c] = cum
        start += n
    # place within the class: the global place in (class, order, tie-break) less the smaller classes
    d = row_index(df, [label, order, tiebreak], "_i")
    before, first = 0, {}
    for c in sorted(counts):
        first[c], before = before, before + counts[c]
    d = d.withColumn("_r", F.col("_i") - F.coalesce(*[F.when(F.col(label) == c, F.lit(n)) for c, n in first.items()]))
    expr = None
    for c, cum in bounds.items():
        e = None
        for i in range(k):  # the last wrap tests the highest block first
            lo = cum[i - 1] if i > 0 else 0
            cond = F.col("_r") >= F.lit(lo)
            e = F.when(cond, F.lit(i)) if e is None else F.when(cond, F.lit(i)).otherwise(e)
        e = F.when(F.col(label) == c, e)
        expr = e if expr is None else F.coalesce(expr, e)
    return d.withColumn(out, expr).drop("_i", "_r")


@dataclass
class CalibratedGBT:
    """For each fold a model and its calibrator: the knots of a rising line."""

    models: list[BoostedTrees] = field(default_factory=list)
    calibrators: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str = "p_primary", features: str = "features") -> DataFrame:
        """Mean of the calibrated probabilities of every (model, calibrator) pair."""
        held = df.sparkSession.sparkContext.broadcast((_Scorer(self.models), self.calibrators))  # as many nodes as the settings allow

        @arrow_udf(DoubleType())
        def mean(vectors: pa.Array) -> pa.Array:
            scorer, knots = held.value
            p = scorer(*vector_rows(vectors))
            return pa.array(sum(np.interp(p[:, m], x, y) for m, (x, y) in enumerate(knots)) / len(knots))

        return df.withColumn(out, mean(F.col(features)))


def fit_calibrated_gbt(train: DataFrame, order: str, tiebreak: str, features: str = "features", label: str = "label",
                       k: int = N_FOLDS, settings: Boosting = Boosting()) -> CalibratedGBT:
    """L1-L3: for each of k stratified folds fit trees on the other folds (positives
    weighted), fit an isotonic calibrator on the held-out fold. All folds grow in the same passes."""
    d = with_class_weight(stratified_folds(train, order, tiebreak, label, k), label)
    d = stored(d.select(F.col(label).cast("double").alias("y"), "weight", "fold", F.col(features).alias("x")), "folds")
    models = fit_boosted(d, "x", "y", "weight", "fold", k, settings)
    own = stored(score_own(d, models, "x", "fold", "p").select("y", "fold", "p"), "held-out")

    def calibrator(i: int) -> tuple[np.ndarray, np.ndarray]:
        rows = own.where(F.col("fold") == i)
        if rows.first() is None:  # fewer rows than folds
            return np.array([0.0, 1.0]), np.array([0.0, 1.0])
        iso = IsotonicRegression(featuresCol="p", labelCol="y", isotonic=True).fit(rows)
        return iso.boundaries.toArray(), iso.predictions.toArray()

    with ThreadPoolExecutor(max_workers=k) as pool:  # independent jobs
        return CalibratedGBT(models, list(pool.map(calibrator, range(k))))


def benign_sample(df: DataFrame, key: str = "session_id", label: str = "label", cap: int = BENIGN_CAP,
                  seed: int = GBT_SEED) -> DataFrame:
    """L4: at most ``cap`` benign rows: the ``cap`` smallest (xxhash64(key, seed), key),
    a deterministic seeded choice without replacement (keys are unique per row).

    A global row index over the two-column (hash, key) table is computed distributed (range
    partitions, no single merge task) and the chosen keys are semi-joined back, broadcast if
    they are few enough.
    """
    b = df.where(F.col(label) == 0)
    h = F.xxhash64(F.col(key), F.lit(seed))
    idx = row_index(b.select(F.col(key), h.alias("_h")), ["_h", key], "_ri")
    keep = idx.where(F.col("_ri") < F.lit(cap)).select(key)
    return b.join(small_side(keep), key, "left_semi")


@dataclass
class SVDModel:
    V: np.ndarray            # d x k
    evr: float

    def transform(self, df: DataFrame, features: str = "features", out: str = "svd") -> DataFrame:
        """X V per row, on Arrow batches (V is d x k, bounded by the feature count)."""
        return project(df, features, self.V, out)


def times(rows: tuple[np.ndarray, np.ndarray, np.ndarray], m: np.ndarray) -> np.ndarray:
    """Sparse rows times a matrix, some rows at a time so that the products stay small."""
    begin, cols, values = rows
    out = np.zeros((len(begin) - 1, m.shape[1]))
    full = np.flatnonzero(np.diff(begin) > 0)
    for part in np.array_split(full, max(1, (int(begin[-1]) * m.shape[1]) >> 23)):
        if len(part):
            lo, hi = begin[part[0]], begin[part[-1] + 1]
            out[part] = np.add.reduceat(m[cols[lo:hi]] * values[lo:hi, None], begin[part] - lo)
    return out


def project(df: DataFrame, features: str, M: np.ndarray, out: str) -> DataFrame:
    """Row vectors times a d x k matrix, from the vectors' nonzero entries (M is broadcast;
    its size is bounded by the feature count times k)."""
    held = df.sparkSession.sparkContext.broadcast(np.asarray(M, dtype=np.float64))

    @arrow_udf(ArrayType(DoubleType()))
    def mul(vectors: pa.Array) -> pa.Array:
        made = times(vector_rows(vectors), held.value)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))

    return df.withColumn(out, mul(F.col(features)))


def _pass(df: DataFrame, features: str, q: np.ndarray, first: bool) -> tuple[np.ndarray, tuple[int, np.ndarray, float] | None]:
    """X^T X q for some columns q of a basis, and with ``first`` also (rows, column sums, sum of squares).

    A task holds one d x columns sum, and sends it on in ranges of rows, each a record; the shuffle adds up
    the records of a range. X stays sparse."""
    held = df.sparkSession.sparkContext.broadcast(q)
    schema = "at int, n long, squares double, sums binary, z binary"

    def cells(at, n, squares, sums, z) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "n": [n], "squares": [squares], "sums": [sums.tobytes()], "z": [z.tobytes()]})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        n, sums, squares, z = 0, np.zeros(len(q)), 0.0, np.zeros(q.shape)
        for b in batches:
            rows = vector_rows(b.column(0))
            begin, cols, values = rows
            y = times(rows, q)
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            used, at = np.unique(cols, return_inverse=True)
            for j in range(q.shape[1]):
                z[used, j] += np.bincount(at, values * y[row, j], len(used))
            n += len(begin) - 1
            sums[used] += np.bincount(at, values, len(used))
            squares += float(values @ values)
        if n:
            for i, lo in enumerate(range(0, len(q), SVD_RANGE)):
                yield cells(i, n, squares, sums[lo:lo + SVD_RANGE] if first else sums[:0], z[lo:lo + SVD_RANGE])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for i in range(b.num_rows):
                at, n, squares = (b.column(c)[i].as_py() for c in ("at", "n", "squares"))
                sums, z = (np.frombuffer(b.column(c)[i].as_buffer()) for c in ("sums", "z"))
                if now is None or now[0] != at:
                    if now is not None:
                        yield cells(*now)
                    now = [at, n, squares, sums.copy(), z.copy()]
                else:
                    now = [at, now[1] + n, now[2] + squares, now[3] + sums, now[4] + z]
        if now is not None:
            yield cells(*now)

    parts = df.select(features).mapInArrow(part, schema)
    res = sorted(parts.repartition("at").sortWithinPartitions("at").mapInArrow(summed, schema).collect(), key=lambda r: r["at"])  # d x columns numbers
    if not res:
        raise ValueError("no rows to fit")
    z = np.concatenate([np.frombuffer(r["z"]) for r in res]).reshape(q.shape)
    return z, (res[0]["n"], np.concatenate([np.frombuffer(r["sums"]) for r in res]), res[0]["squares"]) if first else None


def fit_svd(benign: DataFrame, k: int, features: str = "features", n_iter: int = SVD_ITER, oversample: int = 10,
            seed: int = GBT_SEED) -> SVDModel:
    """Truncated SVD (uncentred) over all columns by a randomised range finder: each of
    ``n_iter`` iterations multiplies the sparse rows with a d x (k + oversample) basis and back, ``SVD_BLOCK``
    columns of it in a pass, so that no task holds more. V is
    the best basis of k columns within that range. Explained variance ratio from the last
    iteration: sum_j var(X v_j) / sum var(X), var(X v) = v^T (X^T X / n) v - (mu . v)^2."""
    first = benign.select(features).first()
    if first is None:
        raise ValueError("no rows to fit")
    d = first[0].size
    width = min(d, k + oversample)
    Q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))
    stats = None
    for i in range(n_iter):
        Z = np.empty_like(Q)
        for lo in range(0, width, SVD_BLOCK):
            Z[:, lo:lo + SVD_BLOCK], got = _pass(benign, features, np.ascontiguousarray(Q[:, lo:lo + SVD_BLOCK]), stats is None)
            stats = stats or got
        if i < n_iter - 1:
            Q, _ = np.linalg.qr(Z)
    n, sx, squares = stats
    G = Q.T @ Z                      # Q^T X^T X Q of the last basis
    vals, vecs = np.linalg.eigh((G + G.T) / 2)
    order = np.argsort(vals)[::-1][:k]
    V, mu = Q @ vecs[:, order], sx / n
    kept = (vals[order] / n - (mu @ V) ** 2).sum()
    tot = squares / n - mu @ mu
    return SVDModel(V, float(kept / tot) if tot > 0 else 0.0)


@dataclass
class Standardiser:
    mean: np.ndarray
    std: np.ndarray

    def transform(self, df: DataFrame, col: str, out: str) -> DataFrame:
        mu = F.array(*[F.lit(float(x)) for x in self.mean])
        sd = F.array(*[F.lit(float(x)) for x in self.std])
        return df.withColumn(out, F.transform(F.col(col), lambda x, i: (x - mu[i]) / sd[i]))


def fit_standardiser(df: DataFrame, col: str, eps: float = 0.0) -> Standardiser:
    """Per-dimension mean and population std (+eps), std 0 -> 1 like scikit-learn."""
    from pyspark.ml.stat import Summarizer
    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(col))).alias("s")) \
        .collect()[0]["s"]
    n = float(s["count"])
    var = s["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)
    std = np.sqrt(var) + eps
    std[std == 0] = 1.0
    return Standardiser(s["mean"].toArray(), std)


@dataclass
class Stacker:
    names: list[str]
    scaler: Standardiser
    weights: np.ndarray
    intercept: float
    thr: float | None = None

    def transform(self, df: DataFrame, out: str = "fusion_score") -> DataFrame:
        """Features bound by name; unknown names fail before any job."""
        missing = [n for n in self.names if n not in df.columns]
        if missing:
            raise ValueError(f"stacker input lacks {missing}")
        margin = F.lit(self.intercept)
        for n, mean, std, w in zip(self.names, self.scaler.mean, self.scaler.std, self.weights, strict=True):
            margin = margin + (F.col(n).cast("double") - F.lit(float(mean))) / F.lit(float(std)) * F.lit(float(w))
        return df.withColumn(out, 1 / (1 + F.exp(-margin)))


def choose_stacker_inputs(columns: Sequence[str], primary: str = "p_primary") -> list[str]:
    """[primary, z_out, z_lat] when both channels exist, else [primary, z_ae]."""
    if "z_out" in columns and "z_lat" in columns:
        return [primary, "z_out", "z_lat"]
    if "z_ae" in columns:
        return [primary, "z_ae"]
    raise ValueError("need z_out and z_lat, or z_ae")


def fit_stacker(df: DataFrame, label: str = "label", primary: str = "p_primary", max_iter: int = 1000) -> Stacker:
    """Standardise, L2 logistic regression with C = 1 (regParam = 1 / n)."""
    names = choose_stacker_inputs(df.columns, primary)
    d = df.withColumn("_sx", F.array(*[F.col(n).cast("double") for n in names]))
    sc = fit_standardiser(d, "_sx")
    d = sc.transform(d, "_sx", "_sz").withColumn("_sv", array_to_vector("_sz")) \
        .withColumn("_y", F.col(label).cast("double"))
    n = d.count()
    lr = LogisticRegression(featuresCol="_sv", labelCol="_y", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-8)
    model = lr.fit(d)
    return Stacker(names, sc, model.coefficients.toArray(), float(model.intercept))


def dimension_stats(df: DataFrame, arr: str, eps: float = 0.0) -> DataFrame:
    """A14 in relational form: (dim, mean, std) with population std (+eps) per array
    position; one exploded aggregate, partial sums map-side."""
    e = df.select(F.posexplode(F.col(arr)).alias("dim", "_x"))
    return e.groupBy("dim").agg(F.avg(F.col("_x").cast("double")).alias("mean"),
                                (F.stddev_pop(F.col("_x").cast("double")) + F.lit(eps)).alias("std"))
