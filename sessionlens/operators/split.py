"""Temporal train/validation split (F1) on exact quantiles (A12) and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles, order_number


@dataclass
class SplitDecision:
    cut_us: float | None      # cut in order units: epoch microseconds for timestamps (may carry a fraction)
    source: str               # 'positives' or 'all'
    n_pos: int
    val_rows: int
    val_pos: int


def decide_cut(sessions: DataFrame, ts: str = "timestamp", label: str = "label", q: float = 0.8,
               min_val_rows: int = 1000, min_val_pos: int = 50, min_val_pos_frac: float = 0.1) -> SplitDecision:
    """cut = q-quantile of positive timestamps (else of all); fall back to the all-rows
    quantile when the validation part is too small or has too few positives.

    Both quantiles come from one grouped, exact, distributed pass (positives are tagged
    into a second group); one more aggregate counts the validation part for both
    candidate cuts. Only scalars reach the driver.
    """
    t = order_number(sessions, ts)
    tagged = sessions.select(t.alias("_t"), F.explode(
        F.when(F.col(label) == 1, F.array(F.lit("all"), F.lit("pos"))).otherwise(F.array(F.lit("all"))))
        .alias("_grp"))
    rows = {r["_grp"]: r["value"] for r in exact_quantiles(tagged, "_t", [q], group_cols=["_grp"]).collect()}
    cut_all, cut_pos = rows.get("all"), rows.get("pos")
    cands = [c for c in (cut_pos, cut_all) if c is not None]
    if not cands:
        return SplitDecision(None, "all", 0, 0, 0)
    aggs = [F.count_if(F.col(label) == 1).alias("n_pos")]
    for i, c in enumerate(cands):
        aggs += [F.count_if(t >= F.lit(c)).alias(f"r{i}"), F.count_if((t >= F.lit(c)) & (F.col(label) == 1)).alias(f"p{i}")]
    v = sessions.agg(*aggs).collect()[0]
    n_pos = int(v["n_pos"])
    i, source = (0, "positives") if cut_pos is not None and n_pos > 0 else (len(cands) - 1, "all")
    if source == "positives" and (v["r0"] < min_val_rows or v["p0"] < max(min_val_pos, min_val_pos_frac * n_pos)):
        i, source = len(cands) - 1, "all"
    return SplitDecision(cands[i], source, n_pos, int(v[f"r{i}"]), int(v[f"p{i}"]))


def apply_split(sessions: DataFrame, cut_us: float | None, ts: str = "timestamp", out: str = "split") -> DataFrame:
    """train: ts < cut, val: ts >= cut, null timestamp: neither (null)."""
    if cut_us is None:
        return sessions.withColumn(out, F.lit(None).cast("string"))
    t = order_number(sessions, ts)
    return sessions.withColumn(out, F.when(t < F.lit(cut_us), "train").when(t >= F.lit(cut_us), "val"))


def temporal_split(sessions: DataFrame, ts: str = "timestamp", label: str = "label", **kw) -> DataFrame:
    d = decide_cut(sessions, ts, label, **kw)
    return apply_split(sessions, d.cut_us, ts)


def split_report(split_df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and positives per part."""
    return split_df.where(F.col("split").isNotNull()).groupBy("split") \
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives"))
