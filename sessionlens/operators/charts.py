"""Score export for dashboards: alias normalising (P16), score synthesis (P17),
percentile flag (P18), cyclic host/service (W9), uniform time grid (W10),
upsampling to chart points (G1), roll-ups (A6, A7, A19)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import epoch_micros, from_epoch_micros
from .ordered import exact_quantiles, row_index

# ---- fixed values (column spellings and chart constants of the source system) ----
SCORE_ALIASES = {
    "session": "session_id", "sid": "session_id", "id": "session_id",
    "score": "anomaly_score", "if_score": "anomaly_score", "iso_score": "anomaly_score",
    "ae_score": "anomaly_score", "recon_error": "anomaly_score", "mse": "anomaly_score",
    "prob": "anomaly_score", "ensemble_score": "anomaly_score", "rank_score": "anomaly_score",
    "y": "label", "y_true": "label", "y_pred": "pred", "prediction": "pred",
    "ens_pct": "anomaly_score",
}
SCORE_NAME_HINTS = ("score", "mse", "error", "prob", "recon", "dist", "pct")
DAYS_BACK = 365
NUM_HOSTS = 50
SERVICES = ("hdfs",)
UPSAMPLE_POINTS = 6
UPSAMPLE_STEP_MIN = 15
TIME_JITTER_MIN = 5
SEED = 42
# ---- end of fixed values ----

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint") 


def normalize_aliases(df: DataFrame) -> DataFrame:
    """Rename known spellings, in column order, only while the target is absent."""
    cols = list(df.columns)
    for c in list(cols):
        tgt = SCORE_ALIASES.get(c)
        if tgt and tgt not in cols:
            df = df.withColumnRenamed(c, tgt)
            cols[cols.index(c)] = tgt
    return df


def synthesize_score(df: DataFrame, out: str = "anomaly_score") -> DataFrame:
    """Min-max scale every numeric column whose name hints at a score, skip
    constant ones, take the row-wise max (null when any used column is null).

    One aggregate of min/max per candidate (a single row) reaches the driver to decide
    which columns are constant.
    """
    types = dict(df.dtypes)
    cands = [c for c in df.columns if any(k in c.lower() for k in SCORE_NAME_HINTS)
             and types[c].split("(")[0] in _NUMERIC]
    if not cands:
        raise ValueError("no score-like numeric column to build anomaly_score from")
    mm = df.agg(*[x for c in cands for x in (F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}"))]).collect()[0]
    used = [(c, float(mm[f"mn_{c}"]), float(mm[f"mx_{c}"])) for c in cands
            if mm[f"mn_{c}"] is not None and mm[f"mx_{c}"] > mm[f"mn_{c}"]]
    if not used:
        raise ValueError("all score columns are constant")
    scaled = [(F.col(c).cast("double") - F.lit(mn)) / F.lit(mx - mn) for c, mn, mx in used]
    any_null = F.lit(False)
    for c, _, _ in used:
        any_null = any_null | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    best = scaled[0] if len(scaled) == 1 else F.greatest(*scaled)
    return df.withColumn(out, F.when(~any_null, best))


def percentile_flag(df: DataFrame, score: str = "anomaly_score", q: float = 0.9, out: str = "pred",
                    threshold: str | None = None) -> DataFrame:
    """pred = score >= exact q-quantile (linear interpolation, nulls skipped);
    null score -> null pred. The threshold is a one-row frame joined by broadcast, and kept
    as a column if ``threshold`` names one."""
    thr = exact_quantiles(df, score, [q]).select(F.col("value").alias("_thr"))
    return df.crossJoin(F.broadcast(thr)) \
        .withColumn(out, F.when(F.col(score).isNotNull(), (F.col(score) >= F.col("_thr")).cast("int"))) \
        .withColumnRenamed("_thr", threshold or "_thr").drop("_thr")


def normalize_ensemble(df: DataFrame) -> DataFrame:
    """P16 + P17 + P7 + P18: any score table -> (session_id, anomaly_score, label, pred)."""
    df = normalize_aliases(df)
    if "session_id" not in df.columns:
        raise ValueError("score table has no session id column")
    if "anomaly_score" not in df.columns:
        df = synthesize_score(df)
    if "label" not in df.columns:
        df = df.withColumn("label", F.lit(0))
    if "pred" not in df.columns:
        df = percentile_flag(df)
    return df.select(F.col("session_id").cast("string"), F.col("anomaly_score").cast("double"),
                     F.col("label").cast("int"), F.col("pred").cast("int"))


def assign_hosts(df: DataFrame, order: Sequence, num_hosts: int = NUM_HOSTS,
                 services: Sequence[str] = SERVICES, idx: str = "row_idx") -> DataFrame:
    """host_{i mod num_hosts + 1:02d}, services[i mod m] for the i-th row in ``order``."""
    d = row_index(df, order, idx) if idx not in df.columns else df
    svc = F.element_at(F.array(*[F.lit(s) for s in services]), (F.pmod(F.col(idx), F.lit(len(services))) + 1).cast("int"))
    return d.withColumn("host", F.format_string("host_%02d", (F.pmod(F.col(idx), F.lit(num_hosts)) + 1).cast("int"))) \
        .withColumn("service", svc)


def jitter_minutes(key_cols: Sequence, jitter: int, seed: int = SEED):
    """Deterministic jitter in [-jitter, jitter] minutes from a hash of the key."""
    if not jitter:
        return F.lit(0)
    return (F.pmod(F.xxhash64(*key_cols, F.lit(seed)), F.lit(2 * jitter + 1)) - F.lit(jitter)).cast("int")


def uniform_times(df: DataFrame, end_ts: str, days_back: int = DAYS_BACK, jitter_min: int = TIME_JITTER_MIN,
                  idx: str = "row_idx", key: str = "session_id", out: str = "timestamp") -> DataFrame:
    """Start + i * step + jitter for the i-th of n rows, step = span / n rounded to
    the microsecond; ``end_ts`` is given (no wall clock), span = ``days_back`` days.
    n comes from one count; the step is a driver scalar."""
    n = max(df.count(), 1)
    step_us = (timedelta(days=days_back) / n) // timedelta(microseconds=1)
    span_us = days_back * 86400 * 1_000_000
    start_us = epoch_micros(F.lit(end_ts)) - F.lit(span_us)
    t_us = start_us + F.col(idx) * F.lit(step_us) + jitter_minutes([F.col(key)], jitter_min) * F.lit(60_000_000)
    return df.withColumn(out, from_epoch_micros(t_us))


def upsample(df: DataFrame, points: int = UPSAMPLE_POINTS, step_min: int = UPSAMPLE_STEP_MIN,
             jitter_min: int = TIME_JITTER_MIN, ts: str = "timestamp", key: str = "session_id") -> DataFrame:
    """G1: each row -> ``points`` rows at t0 + k*step + jitter minutes (k = 0..points-1);
    points <= 1 returns the input. Per-row generation, no shuffle."""
    if points <= 1:
        return df
    d = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    minutes = F.col("_k") * F.lit(step_min) + jitter_minutes([F.col(key), F.col("_k")], jitter_min)
    return d.withColumn(ts, F.timestamp_add("MINUTE", minutes, F.col(ts))).drop("_k")


def chart_rollup(df: DataFrame) -> DataFrame:
    """Per (session_id, host, service): first time, max score, max label, max pred."""
    return df.groupBy("session_id", "host", "service").agg(
        F.min("timestamp").alias("start_time"), F.max("anomaly_score").alias("anomaly_score"),
        F.max("label").alias("label"), F.max("pred").alias("pred"))


def gauge(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Max score per (host, service)."""
    return df.groupBy("host", "service").agg(F.max(score).alias("anomaly_score"))


def max_line_score(df: DataFrame, score: str, key: str = "session_id") -> DataFrame:
    """Session score = max over its line-level scores."""
    return df.groupBy(key).agg(F.max(score).alias("session_score"))
