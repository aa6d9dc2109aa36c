"""Sources: parquet tables, text logs, CSV with explicit schema, shard globs, fallbacks."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import storage as ST
from ..functions import normalize_headers, split_lines
from ..session import stored


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_text_lines(spark: SparkSession, path: str, with_position: bool = True) -> DataFrame:
    """Text log scan, one row per line (``value``).

    Bytes that are not valid UTF-8 decode to U+FFFD; they are removed so the line
    matches a decoder run with errors ignored. With ``with_position`` the file path and
    a per-file order key are kept (file_block_start, then row order inside the split).
    """
    df = spark.read.text(path)
    df = df.withColumn("value", F.regexp_replace("value", "�", ""))
    if with_position:
        df = df.select("value", F.col("_metadata.file_path").alias("file_path"),
                       F.col("_metadata.file_block_start").alias("block_start"),
                       F.monotonically_increasing_id().alias("row_in_split"))
    return df


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
             header: bool = True, normalize: bool = True) -> DataFrame:
    """CSV scan with an explicit schema (no inference at scale)."""
    r = spark.read.option("header", str(header).lower()).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path if isinstance(path, str) else list(path))
    return normalize_headers(df) if normalize else df


def read_csv_checked(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, header: bool = True,
                     record: str = "_record") -> tuple[DataFrame, DataFrame]:
    """S2 with dirty lines: (kept, rejected). ``rejected`` has the lines that don't fit the schema, as
    they stand, in the column ``record``; all else is in ``kept``, headers normalised. The file is read once, into
    a stored table."""
    full = StructType([*_typed(schema).fields, StructField(record, StringType())])
    rows = spark.read.schema(full).option("header", str(header).lower()).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", record).csv(path if isinstance(path, str) else list(path))
    rows = stored(rows, "csv")
    kept = rows.where(F.col(record).isNull()).drop(record)
    return normalize_headers(kept), rows.where(F.col(record).isNotNull()).select(record)


def _typed(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def read_shards(spark: SparkSession, pattern: str, fmt: str = "csv", **kw) -> DataFrame:
    """Shard glob scan, one union; error when nothing matches."""
    if not ST.matches(spark, pattern):
        raise FileNotFoundError(f"no shard matches {pattern}")
    if fmt == "csv":
        return read_csv(spark, pattern, **kw)
    if fmt == "text":
        return read_text_lines(spark, pattern, **kw)
    return spark.read.format(fmt).load(pattern)


def read_first_existing(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **kw) -> DataFrame:
    """First path of an ordered list that exists, then one read."""
    for p in paths:
        if ST.matches(spark, p):
            if fmt == "csv":
                return read_csv(spark, p, **kw)
            return spark.read.format(fmt).load(p)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Text blobs -> (id, line_no, line): the line table a text reader would give."""
    lines = df.select(id_col, F.posexplode(split_lines(F.coalesce(F.col(text_col), F.lit("")))).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("long"))
    return lines
