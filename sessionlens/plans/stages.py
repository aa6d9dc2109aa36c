"""The scoring plan as Spark ML stages (S11, L14): trees, SVD, standardising, channels and
stacker, so that one ``PipelineModel`` holds it, saves it and scores with it.

A stage is written as its metadata (constants) and Parquet tables (trees, matrices in rows), so
nothing as wide as the vocabulary passes as text. Needs no fitted Java model to be read back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import autoenc as AE
from ..operators import models as M
from ..operators.boosting import BoostedTrees
from ..operators.dense_ae import DenseAE
from ..sources import storage as ST

#: Numbers of a matrix that are put into one write.
SLICE = 1 << 22


def save_rows(spark: SparkSession, matrix: np.ndarray, path: str) -> None:
    """A matrix as a table of (row, values), some rows at a time."""
    matrix = np.atleast_2d(matrix)
    step = max(1, SLICE // max(1, matrix.shape[1]))
    for lo in range(0, max(1, len(matrix)), step):
        part = matrix[lo:lo + step]
        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * matrix.shape[1])
        made = pa.table({"row": np.arange(lo, lo + len(part)), "values": pa.ListArray.from_arrays(ends, pa.array(part.ravel()))})
        spark.createDataFrame(made).write.mode("append").parquet(path)


def load_rows(spark: SparkSession, path: str) -> np.ndarray:
    got = spark.read.parquet(path).toPandas().sort_values("row")
    return np.array(got["values"].tolist(), dtype=np.float64)


class _Writer(MLWriter):
    def __init__(self, stage: Stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        constants, matrices, frames = self.stage.state()
        tables = {"constants": constants, "matrices": sorted(matrices), "frames": sorted(frames)}
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, extraMetadata={"stage": tables})
        for name, x in matrices.items():
            save_rows(spark, x, f"{path}/{name}")
        for name, (frame, schema) in frames.items():
            spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False)).selectExpr(
                *[f"CAST({c} AS {kind}) AS {c}" for c, kind in (x.split() for x in schema.split(", "))]).write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls: type[Stage]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Stage:
        spark = self.sparkSession
        held = DefaultParamsReader.loadMetadata(path, spark)["stage"]
        missing = [n for n in held["matrices"] + held["frames"] if not ST.exists(spark, f"{path}/{n}")]
        if missing:
            raise FileNotFoundError(f"missing artifacts {missing} under {path}")
        return self.cls.of(held["constants"], {n: load_rows(spark, f"{path}/{n}") for n in held["matrices"]},
                           {n: spark.read.parquet(f"{path}/{n}").toPandas() for n in held["frames"]})


class Stage(Transformer, MLReadable, MLWritable):
    """A fitted step. ``state`` is what is saved: constants, matrices, and tables with their schema."""

    def state(self) -> tuple[dict, dict[str, np.ndarray], dict[str, tuple[pd.DataFrame, str]]]:
        raise NotImplementedError

    @classmethod
    def of(cls, constants: dict, matrices: dict[str, np.ndarray], frames: dict[str, pd.DataFrame]) -> Stage:
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class TreesStage(Stage):
    """features -> p_primary."""

    SCHEMA = "model int, tree int, node int, col int, threshold double, lower int, upper int, value double"

    def __init__(self, gbt: M.CalibratedGBT):
        super().__init__()
        self.gbt = gbt

    def state(self):
        rows = pd.concat([m.table().assign(model=i) for i, m in enumerate(self.gbt.models)], ignore_index=True)
        rows = rows.rename(columns={"left": "lower", "right": "upper"})[[x.split()[0] for x in self.SCHEMA.split(", ")]]
        knots = {"bases": [m.base for m in self.gbt.models], "knots": [[x.tolist(), y.tolist()] for x, y in self.gbt.calibrators]}
        return knots, {}, {"trees": (rows, self.SCHEMA)}

    @classmethod
    def of(cls, constants, matrices, frames):
        by = dict(list(frames["trees"].rename(columns={"lower": "left", "upper": "right"}).groupby("model")))
        models = [BoostedTrees.of_table(b, by[i].drop(columns="model")) if i in by else BoostedTrees(b, []) for i, b in enumerate(constants["bases"])]
        return cls(M.CalibratedGBT(models, [(np.array(x), np.array(y)) for x, y in constants["knots"]]))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.gbt.predict(df)


class ReduceStage(Stage):
    """features -> _ae_x: the standardised SVD, or the standardised columns where there is none."""

    def __init__(self, svd: M.SVDModel | None, scaler: M.Standardiser):
        super().__init__()
        self.svd, self.scaler = svd, scaler

    def state(self):
        return {"evr": self.svd.evr if self.svd else None}, {"scaler": np.stack([self.scaler.mean, self.scaler.std])} | ({"basis": self.svd.V} if self.svd else {}), {}

    @classmethod
    def of(cls, constants, matrices, frames):
        svd = M.SVDModel(matrices["basis"], constants["evr"]) if "basis" in matrices else None
        return cls(svd, M.Standardiser(*matrices["scaler"]))

    def _transform(self, df: DataFrame) -> DataFrame:
        d = self.svd.transform(df, "features", "_ae_raw") if self.svd else df.withColumn("_ae_raw", vector_to_array(F.col("features")))
        return self.scaler.transform(d, "_ae_raw", "_ae_x").drop("_ae_raw")


class ChannelsStage(Stage):
    """_ae_x -> err_out, z_out, z_lat, z_ae, ae_alert."""

    def __init__(self, ae: AE.LinearAE):
        super().__init__()
        self.ae = ae

    def state(self):
        a = self.ae
        dense = {} if a.P is not None else a.recon.weights
        kept = {"med": a.med, "mad": a.mad, "thr": a.thr, "dense": {k: list(v.shape) for k, v in dense.items()}}
        own = {"axes": a.P} if a.P is not None else {f"dense_{k}": np.atleast_2d(v) for k, v in dense.items()}
        return kept, own | {"code": np.stack([a.code_stats.mean, a.code_stats.std])}, {}

    @classmethod
    def of(cls, constants, matrices, frames):
        if "axes" in matrices:
            recon = AE.LinearRecon(matrices["axes"])
        else:
            recon = DenseAE({k: matrices[f"dense_{k}"].reshape(shape) for k, shape in constants["dense"].items()}, [])
        return cls(AE.LinearAE(recon, M.Standardiser(*matrices["code"]), constants["med"], constants["mad"], constants["thr"]))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.ae.channels(df, "_ae_x").drop("_ae_x")


class StackStage(Stage):
    """The channels, by their names -> fusion_score, is_alert."""

    def __init__(self, stacker: M.Stacker):
        super().__init__()
        self.stacker = stacker

    def state(self):
        s = self.stacker
        return {"names": s.names, "weights": s.weights.tolist(), "intercept": s.intercept, "thr": s.thr, "mean": s.scaler.mean.tolist(), "std": s.scaler.std.tolist()}, {}, {}

    @classmethod
    def of(cls, constants, matrices, frames):
        c = constants
        return cls(M.Stacker(c["names"], M.Standardiser(np.array(c["mean"]), np.array(c["std"])), np.array(c["weights"]), c["intercept"], c["thr"]))

    def _transform(self, df: DataFrame) -> DataFrame:
        thr = self.stacker.thr if self.stacker.thr is not None else 0.5
        return self.stacker.transform(df).withColumn("is_alert", (F.col("fusion_score") >= F.lit(thr)).cast("int"))


def save_plan(plan: PipelineModel, path: str) -> None:
    plan.write().overwrite().save(path)


def load_plan(spark: SparkSession, path: str) -> PipelineModel:
    """The saved plan; what is missing is an error before a job starts."""
    missing = [x for x in ("metadata", "stages") if not ST.exists(spark, f"{path}/{x}")]
    if missing:
        raise FileNotFoundError(f"missing artifacts {missing} under {path}")
    return PipelineModel.load(path)
