"""Detector score tables -> rank ensemble -> chart tables -> gauge.

Mirrors the source flow (ensemble ranks, then the chart export and the live gauge) as
one lazy plan; every step is an operator from ``operators``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts as CH
from ..operators import ranks as RK


def rank_scores(frames: Sequence[DataFrame], score_cols: Sequence[str], key: str = "session_id",
                top_k: int | None = None) -> DataFrame:
    """J5 + W1-W4: merged detector scores with p_<score> ranks and ens_pct, best first."""
    r = RK.rank_ensemble(RK.merge_scores(frames, key), score_cols)
    return RK.top_k(r, top_k, "ens_pct", key) if top_k else r


def export_charts(ranked: DataFrame, end_ts: str, services: Sequence[str] = CH.SERVICES,
                  points: int = CH.UPSAMPLE_POINTS, step_min: int = CH.UPSAMPLE_STEP_MIN,
                  jitter_min: int = CH.TIME_JITTER_MIN, days_back: int = CH.DAYS_BACK):
    """Returns (chart events, chart sessions, gauge)."""
    base = CH.normalize_ensemble(ranked)
    base = CH.assign_hosts(base, [F.col("anomaly_score").desc_nulls_last(), F.col("session_id").asc()],
                           services=services)
    base = CH.uniform_times(base, end_ts, days_back=days_back, jitter_min=jitter_min)
    sessions = CH.chart_rollup(base)
    events = CH.upsample(base.select("timestamp", "host", "service", "session_id", "label", "pred",
                                     "anomaly_score"), points, step_min, jitter_min)
    return events, sessions, CH.gauge(sessions)
