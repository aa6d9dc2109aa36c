"""Binary-classifier evaluation as aggregates over distinct thresholds.

Equal scores are grouped first (one row per distinct threshold with its positives
and negatives), cumulative counts in descending score order come from
``running_totals`` (no single-partition window), and every metric is one aggregate
over that table:

ROC-AUC (ties count half)  = sum(fp * (ctp - tp/2)) / (P * N)
average precision (step)   = sum(tp * ctp / (ctp + cfp)) / P
F-beta operating point     = max fb, first in ascending threshold order
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordered import running_totals

EPS = 1e-9


def _div(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def threshold_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(thr, tp, fp): positives and negatives per distinct score, stored, so that every metric
    reads this table and the rows are read once. Rows without a score (null or NaN) are the row
    with a null ``thr``."""
    x = F.col(score).cast("double")
    pos = F.coalesce(F.col(label), F.lit(0)) == 1
    return stored(df.groupBy(F.when(~F.isnan(x), x).alias("thr"))
                  .agg(F.count_if(pos).alias("tp"), F.count_if(~pos).alias("fp")), "thresholds")


def curve(counts: DataFrame) -> DataFrame:
    """M1/M6 from ``threshold_counts``: (thr, tp, fp, cum_tp, cum_fp, P, N, precision, recall, tpr,
    fpr) per distinct threshold; cum_tp/cum_fp count rows with score >= thr, P/N rows with a score."""
    g = counts.where(F.col("thr").isNotNull())
    c = running_totals(g, "thr", ["tp", "fp"], descending=True, is_stored=True)
    totals = g.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("P"), F.coalesce(F.sum("fp"), F.lit(0)).alias("N"))
    c = c.crossJoin(F.broadcast(totals))  # one row
    return c.withColumn("precision", _div(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))) \
        .withColumn("recall", _div(F.col("cum_tp"), F.col("P"))) \
        .withColumn("tpr", F.col("recall")) \
        .withColumn("fpr", _div(F.col("cum_fp"), F.col("N")))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    c = curve(threshold_counts(df, score, label))
    return c.select("thr", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
                    "precision", "recall", "fpr")


def summary(df: DataFrame, score: str = "score", label: str = "label", beta: float = 1.5) -> DataFrame:
    """M2-M5 + A15: one row with roc_auc, avg_precision, prevalence, ap_gain and the
    F-beta operating point (thr, precision, recall, fbeta)."""
    return _summary(curve(threshold_counts(df, score, label)), beta).drop("_tp", "_fp")


def _summary(c: DataFrame, beta: float) -> DataFrame:
    b2 = beta * beta
    fb = (1 + b2) * F.col("precision") * F.col("recall") / (b2 * F.col("precision") + F.col("recall") + EPS)
    c = c.withColumn("fbeta", F.coalesce(fb, F.lit(0.0)))
    best = F.max_by(F.struct("thr", "precision", "recall", "fbeta", "cum_tp", "cum_fp"), F.struct(F.col("fbeta"), -F.col("thr")))
    agg = c.agg(
        _div(F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2.0)), F.first("P") * F.first("N")).alias("roc_auc"),
        _div(F.sum(F.col("tp") * _div(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))), F.first("P"))
        .alias("avg_precision"),
        F.first("P").alias("n_pos"), F.first("N").alias("n_neg"), best.alias("_b"))
    prev = _div(F.col("n_pos"), F.col("n_pos") + F.col("n_neg"))
    return agg.select("roc_auc", "avg_precision", "n_pos", "n_neg", prev.alias("prevalence"),
                      _div(F.col("avg_precision"), F.greatest(prev, F.lit(1e-12))).alias("ap_gain"),
                      F.col("_b.thr").alias("thr"), F.col("_b.precision").alias("precision"),
                      F.col("_b.recall").alias("recall"), F.col("_b.fbeta").alias("fbeta"),
                      F.col("_b.cum_tp").alias("_tp"), F.col("_b.cum_fp").alias("_fp"))


def fpr_at_tpr(df: DataFrame, target_tpr: float, score: str = "score", label: str = "label") -> DataFrame:
    """M7: highest threshold whose TPR reaches the target, with its FPR."""
    c = curve(threshold_counts(df, score, label)).where(F.col("tpr") >= F.lit(target_tpr))
    best = F.max_by(F.struct("thr", "tpr", "fpr"), F.col("thr"))
    return c.agg(best.alias("_b")).select(F.lit(float(target_tpr)).alias("target_tpr"),
                                         F.col("_b.thr").alias("thr"), F.col("_b.tpr").alias("tpr"),
                                         F.col("_b.fpr").alias("fpr"))


def confusion(df: DataFrame, thr_col_or_value, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts and F1 of pred = score >= thr (thr a number or a one-row frame);
    rows without a score are predicted 0. Sums over the distinct scores."""
    g = threshold_counts(df, score, label)
    if isinstance(thr_col_or_value, DataFrame):
        g = g.crossJoin(F.broadcast(thr_col_or_value.select(F.col("thr").alias("_thr"))))  # one row
    else:
        g = g.withColumn("_thr", F.lit(float(thr_col_or_value)))
    pred = F.coalesce(F.col("thr") >= F.col("_thr"), F.lit(False))
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    return _with_f1(g.agg(total("fp", ~pred).alias("tn"), total("fp", pred).alias("fp"),
                          total("tp", ~pred).alias("fn"), total("tp", pred).alias("tp")))


def _with_f1(counts: DataFrame) -> DataFrame:
    f1 = _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """scale_pos_weight = max(1, neg / max(1, pos))."""
    a = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return a.withColumn("pos_weight", F.greatest(F.lit(1.0), F.col("neg") / F.greatest(F.col("pos"), F.lit(1))))


def metrics_record(df: DataFrame, score: str = "score", label: str = "label", beta: float = 1.5,
                   features_used: Sequence[str] = ()) -> DataFrame:
    """M5: one row with ROC-AUC, AP, prevalence, AP gain, F1 at the F-beta threshold, that
    threshold's precision and recall, the stacker's inputs and whether one was used. The confusion counts at the threshold are a row of the
    curve, plus the positives without a score."""
    g = threshold_counts(df, score, label)
    lost = g.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("_all"))
    s = _summary(curve(g), beta).crossJoin(F.broadcast(lost))  # one row each
    s = s.withColumn("_hit", F.coalesce("_tp", F.lit(0)))
    f1 = _div(2 * F.col("_hit"), F.col("_hit") + F.coalesce("_fp", F.lit(0)) + F.col("_all"))
    s = s.withColumn("features_used", F.array(*[F.lit(c) for c in features_used]).cast("array<string>"))
    return s.withColumn("stacker_on", F.size("features_used") > 0).withColumn("f1", F.coalesce(f1, F.lit(0.0))) \
        .drop("_tp", "_fp", "_all", "_hit")
