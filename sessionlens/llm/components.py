"""Connected components of a stored edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """u, root: for each node u of ``edges`` (u, v) that isn't the smallest of its component, the
    smallest. Each round hangs the neighbours of a node on the smallest among them, so the number
    of rounds follows the logarithm of the size of a component; each round is written as a table.
    Minima are taken before a shuffle, and the joins on a node with many neighbours are split by
    adaptive execution. Null ends and loops are ignored."""
    own = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, was = stored(own, name), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            return now.select("u", F.col("v").alias("root"))
        was = mark
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(hung.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), name)
