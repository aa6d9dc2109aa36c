"""Reconstruction-error detector.

Step 1: a linear autoencoder = principal subspace of the standardised benign rows (Spark
ML PCA, k = bottleneck). code = P^T x, reconstruction = P code.
Step 2: the dense autoencoder of ``dense_ae`` (parameter averaging); same channels.
Channels:
  z_out = robust z of the per-row mean squared reconstruction error
          ((err - median) / (1.4826 * MAD)), median/MAD from benign reference rows (L10)
  z_lat = L2 norm of the per-dimension z of the code, benign train statistics (L9)
  z_ae  = 0.6 * z_out + 0.4 * z_lat, threshold = q0.995 of benign reference rows (L11)
Every statistic is an exact distributed aggregate; products with matrices run on Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .models import Standardiser, fit_standardiser
from .ordered import exact_quantiles

# ---- fixed values (detector constants of the source system) ----
BOTTLENECK = 16
ALPHA = 0.6
MAD_SCALE = 1.4826
MAD_EPS = 1e-9
STD_EPS = 1e-9
THRESHOLD_Q = 0.995
# ---- end of fixed values ----


@dataclass
class LinearRecon:
    """Linear autoencoder: code = P^T x, reconstruction = P code (P: d x k)."""
    P: np.ndarray

    def reconstruct(self, df: DataFrame, x: str) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self.P)

        @arrow_udf("code array<double>, err double")
        def coded(rows: pa.Array) -> pa.Array:
            P = held.value
            X = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), P.shape[0])
            code = X @ P
            err = ((X - code @ P.T) ** 2).mean(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * P.shape[1]), pa.array(code.ravel()))
            return pa.StructArray.from_arrays([lists, pa.array(err)], names=["code", "err"])

        d = df.withColumn("_coded", coded(F.col(x)))
        return d.withColumns({"_code": F.col("_coded.code"), "err_out": F.col("_coded.err")}).drop("_coded")


@dataclass
class LinearAE:
    """Reconstruction detector: any ``recon`` with ``reconstruct(df, x)`` giving err_out and
    _code (LinearRecon, or DenseAE from ``dense_ae``), plus the benign statistics."""
    recon: object
    code_stats: Standardiser       # benign train mean/std of the code
    med: float = 0.0
    mad: float = 1.0
    thr: float | None = None

    @property
    def P(self) -> np.ndarray:  # linear axes (kept for callers that save them)
        return getattr(self.recon, "P", None)

    def channels(self, df: DataFrame, x: str) -> DataFrame:
        """err_out, z_out, z_lat, z_ae (and ae_alert once the threshold is set)."""
        d = self.recon.reconstruct(df, x)
        d = self.code_stats.transform(d, "_code", "_zc")
        d = d.withColumn("z_lat", F.sqrt(F.aggregate("_zc", F.lit(0.0), lambda acc, v: acc + v * v)))
        d = d.withColumn("z_out", (F.col("err_out") - F.lit(self.med)) / F.lit(MAD_SCALE * self.mad))
        d = d.withColumn("z_ae", F.lit(ALPHA) * F.col("z_out") + F.lit(1 - ALPHA) * F.col("z_lat"))
        if self.thr is not None:
            d = d.withColumn("ae_alert", (F.col("z_ae") >= F.lit(self.thr)).cast("int"))
        return d.drop("_code", "_zc")


def _with_code_stats(recon, benign_train: DataFrame, x: str) -> LinearAE:
    coded = recon.reconstruct(benign_train, x)
    return LinearAE(recon, fit_standardiser(coded, "_code", eps=STD_EPS))


def fit_linear_ae(benign_train: DataFrame, x: str, k: int = BOTTLENECK) -> LinearAE:
    """Step 1: PCA subspace of the benign training rows (array column ``x``)."""
    v = benign_train.withColumn("_xv", array_to_vector(F.col(x)))
    pca = PCA(k=k, inputCol="_xv", outputCol="_pc").fit(v)
    return _with_code_stats(LinearRecon(pca.pc.toArray()), benign_train, x)


def fit_dense_ae_detector(benign_train: DataFrame, x: str, key: str, k: int = BOTTLENECK,
                          hidden: int | None = None, max_epochs: int | None = None) -> LinearAE:
    """Step 2: dense autoencoder trained by parameter averaging (see ``dense_ae``)."""
    from . import dense_ae as D
    ae = D.fit_dense_ae(benign_train, x, key, bottleneck=k, hidden=hidden or D.HIDDEN,
                        max_epochs=max_epochs or D.MAX_EPOCHS)
    return _with_code_stats(ae, benign_train, x)


def robust_stats(ref: DataFrame, col: str = "err_out") -> tuple[float, float]:
    """Median and MAD (+eps) of ``col`` on reference rows, two exact aggregates."""
    med = exact_quantiles(ref, col, [0.5]).collect()[0]["value"]
    med = float(med) if med is not None else 0.0
    mad = exact_quantiles(ref.select(F.abs(F.col(col) - F.lit(med)).alias("_d")), "_d", [0.5]).collect()[0]["value"]
    return med, (float(mad) if mad is not None else 0.0) + MAD_EPS


def calibrate(ae: LinearAE, benign_ref: DataFrame, x: str) -> LinearAE:
    """Set median/MAD and the fused threshold from benign reference rows. The channels
    are computed once and kept (memory and disk) for the three exact aggregates."""
    from pyspark import StorageLevel
    ch = ae.channels(benign_ref, x).select("err_out", "z_lat").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ae.med, ae.mad = robust_stats(ch)
        z_out = (F.col("err_out") - F.lit(ae.med)) / F.lit(MAD_SCALE * ae.mad)
        fused = ch.select((F.lit(ALPHA) * z_out + F.lit(1 - ALPHA) * F.col("z_lat")).alias("z_ae"))
        t = exact_quantiles(fused, "z_ae", [THRESHOLD_Q]).collect()[0]["value"]
        ae.thr = float(t) if t is not None else None
    finally:
        ch.unpersist()
    return ae
