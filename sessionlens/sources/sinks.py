"""Sinks: sharded and partitioned writes (S7, S8), single small reports (S9),
metrics records (S12) and shard numbering (W7)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import row_index

LINES_PER_FILE = 500_000      # S7 shard size
ROWS_PER_PART = 100_000       # S8 part size


def write_sharded(df: DataFrame, path: str, fmt: str = "csv", rows_per_file: int = LINES_PER_FILE,
                  mode: str = "overwrite") -> None:
    """Files of at most ``rows_per_file`` rows each, written by parallel tasks."""
    w = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def shard_numbers(df: DataFrame, order: Sequence, rows_per_part: int = ROWS_PER_PART,
                  out: str = "part") -> DataFrame:
    """part = floor(global row index / rows_per_part) in ``order`` order."""
    d = row_index(df, order, "_ri")
    return d.withColumn(out, F.floor(F.col("_ri") / F.lit(rows_per_part)).cast("long")).drop("_ri")


def write_parts(df: DataFrame, path: str, order: Sequence, rows_per_part: int = ROWS_PER_PART,
                fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Sorted rows cut into ``part=K`` directories of ``rows_per_part`` rows."""
    shard_numbers(df, order, rows_per_part).write.mode(mode).partitionBy("part").format(fmt).save(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One file for a small report table (callers pass bounded tables only)."""
    w = df.coalesce(1).write.mode(mode)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> DataFrame:
    """A key/value record as a one-row JSON table."""
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(metrics, default=float)], 1))
    df.coalesce(1).write.mode("overwrite").json(path)
    return df
