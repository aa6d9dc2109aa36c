"""Small files on whatever storage Spark reaches, through the session's Hadoop FileSystem."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a plain path or a glob matches, sorted."""
    fs, p = _at(spark, pattern)
    found = fs.globStatus(p)
    return sorted(f.getPath().toString() for f in found) if found is not None else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Create the file; without ``overwrite`` an existing one is an error."""
    fs, p = _at(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
