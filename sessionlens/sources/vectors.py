"""Keyed tables that join without a shuffle (S10): vectors, scores and the like, bucketed and sorted by their
key, so that J6, J8 and scoring bring rows together by the key and never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Buckets of a table; tables that are joined have the same number.
BUCKETS = 64


def write_keyed(df: DataFrame, table: str, path: str, key: str = "session_id", buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` to ``path`` as the catalog's ``table``, one file for each bucket of ``key``; returns it as read back."""
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet")
     .mode("overwrite").saveAsTable(table))
    return read_keyed(df.sparkSession, table, key)


def read_keyed(spark: SparkSession, table: str, key: str = "session_id") -> DataFrame:
    """The table; one that isn't bucketed by ``key`` is an error, since its joins would shuffle."""
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if said.get("Bucket Columns") != f"[`{key}`]":
        raise ValueError(f"{table} isn't bucketed by {key}")
    return spark.table(table)
