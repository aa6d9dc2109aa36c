"""Offline training (E1 steps 4-6) and batch scoring (E2) on a session feature table.

Input: one row per session with ``session_id``, ``timestamp``, ``label`` and an ML
vector ``features``. Training splits in time (F1), fits the calibrated trees (L1-L3),
the reconstruction detector on benign rows (L4-L11) and the stacker on validation
rows (L12-L13), then picks the F-beta threshold (M4). Scoring applies every artifact
in one plan (L14-L16) and yields the alert table (T10).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import autoenc as AE
from ..operators import evaluation as EV
from ..operators import models as M
from ..operators.boosting import Boosting
from ..operators.split import apply_split, decide_cut
from ..session import stored
from .stages import ChannelsStage, ReduceStage, StackStage, TreesStage, load_plan, save_plan

ALERT_COLUMNS = ["session_id", "timestamp", "p_score_iso", "z_ae", "fusion_score", "is_alert", "label"]


@dataclass
class Detectors:
    """What training has fitted. ``plan`` is all of it as one PipelineModel."""

    gbt: M.CalibratedGBT
    svd: M.SVDModel | None
    scaler: M.Standardiser
    ae: AE.LinearAE
    stacker: M.Stacker
    cut_us: float | None = None

    def plan(self) -> PipelineModel:
        return PipelineModel([TreesStage(self.gbt), ReduceStage(self.svd, self.scaler), ChannelsStage(self.ae), StackStage(self.stacker)])

    # ------------------------------------------------------------------ S11 save / load
    def save(self, path: str) -> None:
        save_plan(self.plan(), path)

    @staticmethod
    def load(path: str) -> Detectors:
        trees, reduce_, channels, stack = load_plan(SparkSession.active(), path).stages
        return Detectors(trees.gbt, reduce_.svd, reduce_.scaler, channels.ae, stack.stacker)

    # ------------------------------------------------------------------ channels
    def ae_input(self, df: DataFrame) -> DataFrame:
        return ReduceStage(self.svd, self.scaler).transform(df)

    def channels(self, df: DataFrame) -> DataFrame:
        return ChannelsStage(self.ae).transform(self.ae_input(TreesStage(self.gbt).transform(df)))

    def score(self, df: DataFrame) -> DataFrame:
        """The alert table for any session feature rows (label -1 when absent)."""
        d = self.plan().transform(df)
        if "label" not in d.columns:
            d = d.withColumn("label", F.lit(-1))
        return alert_table(d)


def alert_table(d: DataFrame) -> DataFrame:
    """T10 projection (p_primary exported under its dashboard name)."""
    return d.select("session_id", "timestamp", F.col("p_primary").alias("p_score_iso"), "z_ae", "fusion_score",
                    "is_alert", F.col("label").cast("int").alias("label"), "z_out", "z_lat")


def train_detectors(feats: DataFrame, order: str = "timestamp", tiebreak: str = "session_id",
                    svd_k: int | None = None, bottleneck: int = AE.BOTTLENECK, trees: Boosting = Boosting(),
                    folds: int = M.N_FOLDS, benign_cap: int = M.BENIGN_CAP,
                    min_val_rows: int = 1000, min_val_pos: int = 50, ae_kind: str = "linear",
                    ae_hidden: int | None = None, ae_epochs: int | None = None) -> tuple[Detectors, DataFrame]:
    """Fit every detector; returns the artifacts and the validation alert table. The trees read the columns
    of ``features`` as they are, sparse."""
    # lineage cut: the feature table is read by every fit below (reliable checkpoint,
    # so a lost executor re-reads it instead of recomputing the features)
    feats = stored(feats, "features")
    dec = decide_cut(feats, order, "label", min_val_rows=min_val_rows, min_val_pos=min_val_pos)
    sp = apply_split(feats, dec.cut_us, order)
    train = sp.where(F.col("split") == "train")
    val = sp.where(F.col("split") == "val")
    benign_tr = train.where(F.col("label") == 0)
    # the cap holds for the SVD fit only; scaler, autoencoder and code statistics read all benign rows
    svd = M.fit_svd(stored(M.benign_sample(train, tiebreak, "label", benign_cap).select("features"), "benign-sample"), svd_k) if svd_k else None
    gbt = M.fit_calibrated_gbt(train, order, tiebreak, "features", "label", folds, trees)
    raw = svd.transform(benign_tr, "features", "_ae_raw") if svd else \
        benign_tr.withColumn("_ae_raw", vector_to_array(F.col("features")))
    scaler = M.fit_standardiser(raw, "_ae_raw")
    det = Detectors(gbt, svd, scaler, None, None, dec.cut_us)  # type: ignore[arg-type]
    x_tr = det.ae_input(benign_tr)
    if ae_kind == "dense":
        det.ae = AE.fit_dense_ae_detector(x_tr, "_ae_x", tiebreak, bottleneck, ae_hidden, ae_epochs)
    else:
        det.ae = AE.fit_linear_ae(x_tr, "_ae_x", bottleneck)
    det.ae = AE.calibrate(det.ae, det.ae_input(val.where(F.col("label") == 0)), "_ae_x")
    # validation channels feed the stacker fit, its scoring and the threshold search:
    # computed once (memory and disk) instead of re-running every model per action
    ch = det.channels(val).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        det.stacker = M.fit_stacker(ch, "label", "p_primary")
        fused = det.stacker.transform(ch)
        best = EV.summary(fused, "fusion_score", "label").select("thr").collect()[0]["thr"]
        det.stacker.thr = float(best) if best is not None else 0.5
        out = fused.withColumn("is_alert", (F.col("fusion_score") >= F.lit(det.stacker.thr)).cast("int"))
        out = stored(alert_table(out), "alerts")
    finally:
        ch.unpersist()
    return det, out
