"""Rank ensemble: full outer merge of detector scores (J5), percentile ranks with
average ties (W1), mean of available ranks (W2), global order and top-k (W3, W4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordered import average_rank_pct, row_index


def merge_scores(frames: Sequence[DataFrame], key: str = "session_id") -> DataFrame:
    """Successive FULL OUTER joins on the key (key columns coalesced by USING)."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def nan_to_null(c):
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def rank_ensemble(df: DataFrame, score_cols: Sequence[str], out: str = "ens_pct") -> DataFrame:
    """W1 + W2: ``p_<score>`` = percentile rank (average ties, nulls and NaN skipped);
    ``out`` = mean of the available ranks, null when none is available."""
    for c in score_cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
        df = df.withColumn(c, nan_to_null(F.col(c).cast("double")))
    # the score table is read by the rank pass and by the join back: cut its lineage once
    # so upstream sources are not re-read per branch
    df = stored(df, "scores")
    df = average_rank_pct(df, score_cols, "p_")
    ps = [F.col(f"p_{c}") for c in score_cols]
    n = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in ps])
    s = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in ps])
    return df.withColumn(out, F.when(n > 0, s / n))


def top_k(df: DataFrame, k: int, col: str = "ens_pct", key: str = "session_id", rank: str | None = None) -> DataFrame:
    """W3 + W4: descending global order (ties by key, nulls last); first ``k`` rows, numbered
    from 1 in a column ``rank`` if it is named.

    The order comes from ``row_index`` (range partitions), so no task merges the k first rows
    of every other task.
    """
    name = rank or "_rank"
    d = row_index(df, [F.col(col).desc_nulls_last(), F.col(key).asc()], name)
    d = d.where(F.col(name) < k)
    return d.withColumn(name, F.col(name) + 1) if rank else d.drop(name)
