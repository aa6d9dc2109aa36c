"""Keyed upsert (S13) with null-normalising casts (P20).

The target is a Parquet table partitioned by hash buckets of its key. An upsert reads the buckets that its
batch touches, keeps the rows whose key is not in the batch (left anti join), appends the batch, and
replaces these buckets by Spark's dynamic partition overwrite. The merged rows are written beside the
table first: a job that fails before that leaves the table as it was, and one that ends while buckets
are being replaced is finished from that copy by the next reader or writer. A re-run of the same batch gives the
same table (idempotent). One writer at a time; the target may lie on any storage that the executors share.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import null_normalised_timestamp
from ..session import discard, stored
from . import storage as ST

#: Buckets of a new table. An existing one keeps its own number, which its folders' names hold.
N_BUCKETS = 64

ALERT_TYPES = {  # the alert table's column types
    "session_id": "string", "timestamp": "timestamp", "p_score_iso": "double", "z_ae": "double",
    "fusion_score": "double", "is_alert": "int", "label": "int",
}


def normalise_batch(batch: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """P20: '' / 'NaT' / null timestamps -> NULL; other columns ``try_cast`` to type."""
    cols = []
    for c, t in types.items():
        if c not in batch.columns:
            cols.append(F.lit(None).cast(t).alias(c))
        elif t.startswith("timestamp"):
            cols.append(null_normalised_timestamp(c).cast(t).alias(c))
        else:
            cols.append(F.col(c).try_cast(t).alias(c))
    return batch.select(*cols)


def check_unique(batch: DataFrame, key: str) -> None:
    """A batch that repeats a key is rejected (as a primary-key insert would be)."""
    dup = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if dup:
        raise ValueError(f"batch repeats key {key}={dup[0][key]!r}")


def merge(target: DataFrame | None, batch: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of ``target`` whose key is absent from ``batch``, then every batch row."""
    if target is None:
        return batch
    return target.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def _buckets(spark: SparkSession, path: str) -> list[str]:
    """Names of the table's buckets: number of buckets, underscore, bucket."""
    return [p.rsplit("=", 1)[1] for p in ST.matches(spark, f"{path}/bucket=*")]


def _finish(spark: SparkSession, path: str) -> None:
    """Replace the buckets of a whole merged copy, if there is one, and drop it."""
    copy = f"{path}/_merged"
    if ST.exists(spark, f"{copy}/_SUCCESS"):
        (spark.read.parquet(copy).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
        ST.remove(spark, copy)


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    _finish(spark, path)
    return spark.read.option("mergeSchema", "true").parquet(path).drop("bucket") if _buckets(spark, path) else None


def upsert(spark: SparkSession, path: str, batch: DataFrame, key: str = "session_id",
           types: Mapping[str, str] | None = None, n_buckets: int = N_BUCKETS, gone: str | None = None) -> None:
    """Apply ``batch`` to the keyed table at ``path``.

    Only the buckets that the batch touches are read and written. ``gone`` names a Boolean column of the
    batch: where it holds, the key leaves the table. The batch's own copy is deleted in the end.
    """
    b = stored(normalise_batch(batch, types) if types else batch, "upsert-batch")
    try:
        check_unique(b, key)
        _finish(spark, path)
        old = _buckets(spark, path)
        n = int(old[0].split("_")[0]) if old else n_buckets
        bucket = F.concat_ws("_", F.lit(str(n)), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("string"))
        touched = [r[0] for r in b.select(bucket).distinct().collect()]  # n at most
        held = [x for x in touched if x in old]
        # by partition, so that only the touched buckets are listed and read
        now = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*[f"{path}/bucket={x}" for x in held]).drop("bucket") if held else None
        new = merge(now, b, key)
        if gone:
            new = new.where(~F.coalesce(F.col(gone), F.lit(False))).drop(gone)
        new.withColumn("bucket", bucket).write.mode("overwrite").parquet(f"{path}/_merged")
        if gone:  # an overwrite leaves buckets alone that get no row
            left = {r[0] for r in spark.read.parquet(f"{path}/_merged").select("bucket").distinct().collect()}
            for x in set(held) - left:
                ST.remove(spark, f"{path}/bucket={x}")
        _finish(spark, path)
    finally:
        discard(b)
