"""ROC-AUC, step AP, F-beta point and confusion against numpy brute force."""

import numpy as np
import pytest

from sessionlens.operators import evaluation as EV

SCORES = [0.1, 0.4, 0.35, 0.8, 0.8, 0.2, 0.9, 0.55, 0.55, 0.3, None, 0.7]
LABELS = [0, 0, 1, 1, 0, 0, 1, 1, 0, 0, 1, 1]


def brute(scores, labels):
    s = np.array([x for x in scores if x is not None])
    y = np.array([l for x, l in zip(scores, labels) if x is not None])
    P, N = y.sum(), (1 - y).sum()
    pairs = [(a, b) for a in s[y == 1] for b in s[y == 0]]
    auc = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs])
    ths = np.unique(s)[::-1]
    ap, prev_r, best = 0.0, 0.0, (-1, None)
    for t in ths:
        tp = ((s >= t) & (y == 1)).sum()
        fp = ((s >= t) & (y == 0)).sum()
        p, r = tp / (tp + fp), tp / P
        ap += (r - prev_r) * p
        prev_r = r
        fb = (1 + 2.25) * p * r / (2.25 * p + r + 1e-9)
        if fb >= best[0]:          # ascending order would keep the first max: lower thr wins ties
            best = (fb, t)
    return auc, ap, best


def test_summary_matches_brute(spark):
    df = spark.createDataFrame(list(zip(SCORES, LABELS)), "score double, label int")
    r = EV.summary(df).collect()[0]
    auc, ap, (fb, thr) = brute(SCORES, LABELS)
    assert r.roc_auc == pytest.approx(auc)
    assert r.avg_precision == pytest.approx(ap)
    assert r.fbeta == pytest.approx(fb)
    assert r.thr == pytest.approx(thr)


def test_curve_monotone_and_confusion(spark):
    df = spark.createDataFrame(list(zip(SCORES, LABELS)), "score double, label int")
    c = EV.pr_curve(df).orderBy("thr").collect()
    assert [x.tp for x in c] == sorted([x.tp for x in c], reverse=True)
    cm = EV.confusion(df, 0.55).collect()[0]
    s = np.array([x if x is not None else -np.inf for x in SCORES])
    y = np.array(LABELS)
    pred = s >= 0.55
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (((~pred) & (y == 0)).sum(), (pred & (y == 0)).sum(),
                                            ((~pred) & (y == 1)).sum(), (pred & (y == 1)).sum())


def test_fpr_at_tpr(spark):
    df = spark.createDataFrame(list(zip(SCORES, LABELS)), "score double, label int")
    r = EV.fpr_at_tpr(df, 0.5).collect()[0]
    assert r.tpr >= 0.5
