"""Schema-level helpers: header normalising, required columns, backfills and casts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidate text columns for the session document, first present wins (fixed order).
TEXT_COLUMN_CANDIDATES = ("log_key", "template_id", "event_template", "message", "log_message", "service")


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip and lower-case every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "input") -> DataFrame:
    """Fail on the driver, before any job runs, when a column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; has {df.columns}")
    return df


def first_present(df: DataFrame, candidates: Sequence[str] = TEXT_COLUMN_CANDIDATES) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def backfill_key(df: DataFrame) -> DataFrame:
    """block_id <-> session_id backfill (either one may be missing)."""
    if "block_id" not in df.columns and "session_id" in df.columns:
        df = df.withColumn("block_id", F.col("session_id").cast("string"))
    if "session_id" not in df.columns and "block_id" in df.columns:
        df = df.withColumn("session_id", F.col("block_id").cast("string"))
    return df


def coalesce_cast(c, default, dtype: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col, F.lit(default)).cast(dtype)


_EPOCH = "1970-01-01 00:00:00"


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of the wall-clock value, as a naive (UTC) timestamp:
    the same number whatever the session time zone (no DST shifts)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), col.cast("timestamp_ntz"))


def from_epoch_micros(us) -> Column:
    """Inverse of ``epoch_micros``: a ``timestamp_ntz``."""
    u = F.col(us) if isinstance(us, str) else us
    return F.timestamp_add("MICROSECOND", u, F.lit(_EPOCH).cast("timestamp_ntz"))


def duration_seconds(start, end) -> Column:
    """(end - start) in seconds as double; null when either end is null."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1e6)


def parse_timestamp(c, strict: bool = False) -> Column:
    """Strict parse raises on bad text (ANSI cast); lenient parse yields null."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("timestamp") if strict else F.try_to_timestamp(col.cast("string"))


def null_normalised_timestamp(c) -> Column:
    """'' and 'NaT' (and null) become NULL, anything else is parsed leniently."""
    col = F.col(c) if isinstance(c, str) else c
    s = col.cast("string")
    return F.when(s.isNull() | s.isin("", "NaT"), F.lit(None).cast("timestamp")) \
        .otherwise(F.try_to_timestamp(s))
