"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.session import small_side, stored

__all__ = ["batches", "clashless", "gathered", "small_batches", "small_side", "stored", "table", "text_size", "trimmed", "words"]

#: One character of white space as the word rules name it: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch of texts, where the session has Spark's default.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default of 10,000, which for texts is tens of MB in
    the JVM and again in Python, for each running task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def clashless(df: DataFrame, own: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns ``own`` of ``df``, missing ones of ``also`` as nulls: extra columns of
    an input can't clash with the names that an operator adds."""
    out = df.select(*[F.col(f"`{c}`") for c in own if c in df.columns])
    for c in also:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def batches(frames: Iterator[pd.DataFrame], size: Callable[[pd.Series], pd.Series], column: str,
            most: int) -> Iterator[pd.DataFrame]:
    """Cut each frame where the running ``size`` of ``column`` passes ``most``, so that a frame
    with very long texts isn't worked on at once. A single row stays whole."""
    for frame in frames:
        if not len(frame):
            continue
        part = (size(frame[column]).cumsum() // most).to_numpy()
        for _, rows in frame.groupby(part, sort=True):
            yield rows


def gathered(frames: Iterator[pd.DataFrame], rows: int, size: Callable[[pd.DataFrame], int] = lambda f: 0, most: int = 1) -> Iterator[pd.DataFrame]:
    """The frames put together until they have ``rows`` rows at least, or a ``size`` of ``most``."""
    held, n, total = [], 0, 0
    for f in frames:
        held.append(f)
        n += len(f)
        total += size(f)
        if n >= rows or total >= most:
            yield pd.concat(held, ignore_index=True)
            held, n, total = [], 0, 0
    if n:
        yield pd.concat(held, ignore_index=True)


def trimmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames; after the last one, what the worker has freed goes back to the system. A worker waits idle for a minute,
    beside what the next stage needs."""
    yield from frames
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def text_size(texts: pd.Series) -> pd.Series:
    return texts.str.len().fillna(0).astype("int64") + 1
