"""Boosted trees against a plain booster that keeps all rows in memory and grows one leaf at a time."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors

from sessionlens.operators import boosting as B


def plain(X, y, w, bins, masks, s, base):
    """Margins after each round; trees as (col, bin, ...) in the order of their splits."""
    margin, out, after = np.full(len(y), base), [], []
    binned = np.stack([bins.of(np.full(len(X), c), X[:, c]) for c in range(X.shape[1])], 1)

    def best(rows, g, h, mask):
        found = None
        G, H = g[rows].sum(), h[rows].sum()
        score = lambda a, b: max(abs(a) - s.l1, 0) ** 2 / (b + s.l2)
        for c in np.flatnonzero(mask):
            for b in range(bins.begin[c + 1] - bins.begin[c]):
                left = rows[binned[rows, c] <= b]
                if not s.min_rows <= len(left) <= len(rows) - s.min_rows:
                    continue
                a, k = g[left].sum(), h[left].sum()
                if k < s.min_hessian or H - k < s.min_hessian:
                    continue
                gain = score(a, k) + score(G - a, H - k) - score(G, H)
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, c, b, left)
        return found

    for mask in masks:
        g, h = B.gradients(y, w, margin)
        leaves = [(np.arange(len(y)), best(np.arange(len(y)), g, h, mask))]
        splits = []
        while len(leaves) < s.leaves and any(f for _, f in leaves):
            k = max(range(len(leaves)), key=lambda i: leaves[i][1][0] if leaves[i][1] else -1)
            rows, (gain, c, b, left) = leaves.pop(k)
            splits.append((c, b, len(left)))
            right = np.setdiff1d(rows, left)
            leaves += [(x, best(x, g, h, mask)) for x in (left, right)]
        for rows, _ in leaves:
            margin[rows] += -np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - s.l1, 0) / (h[rows].sum() + s.l2) * s.step
        out.append(splits)
        after.append(margin.copy())
    return out, after


def data(n=400, d=7, seed=1):
    r = np.random.default_rng(seed)
    X = r.normal(size=(n, d)) * (r.random((n, d)) < 0.6)
    X[:, 3] = r.integers(0, 3, n)
    y = (X[:, 0] + X[:, 1] * X[:, 2] + 0.5 * X[:, 3] + r.normal(size=n) * 0.3 > 0.5).astype(float)
    return X, y, np.where(y > 0, 2.0, 1.0) * r.uniform(0.5, 1.5, n)  # few ties


def frame(spark, X, y, w, fold, more=()):
    vec = lambda i, v: Vectors.dense(v.tolist()) if i % 3 == 0 else Vectors.sparse(len(v), np.flatnonzero(v).tolist(), v[v != 0].tolist())
    rows = [(i, vec(i, X[i]), int(y[i]), float(w[i]), int(fold[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, ["i", "features", "label", "weight", "fold"]).repartition(5)


@pytest.mark.parametrize("s,held", [(B.Boosting(rounds=5, step=0.3, leaves=9, min_rows=5, bins=12), B.HELD), (B.Boosting(rounds=3, step=0.5, leaves=30, columns=1.0, min_rows=2, bins=200), 50)], ids=["some", "many"])
def test_trees_equal_a_plain_booster(spark, monkeypatch, s, held):
    monkeypatch.setattr(B, "REFRESH", 2)
    monkeypatch.setattr(B, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(B, "HELD", held)
    X, y, w = data()
    fold = np.arange(len(y)) % 2
    df = frame(spark, X, y, w, fold)
    bins = B.fit_bins(df, "features", s.bins)
    models = B.fit_boosted(df, weight="weight", fold="fold", models=2, settings=s)
    got = {r.i: r.p for r in B.score_boosted(df, models, out="p").select("i", "p").collect()}
    for m in range(2):
        own = np.flatnonzero(fold != m)
        share = (w * y)[own].sum() / w[own].sum()
        masks = [B.column_sample(X.shape[1], s.columns, s.seed, r, m) for r in range(s.rounds)]
        assert models[m].base == pytest.approx(np.log(share / (1 - share)))
        splits, margins = plain(X[own], y[own], w[own], bins, masks, s, models[m].base)
        for t, want in zip(models[m].trees, splits, strict=True):
            inner = t[t["left"] >= 0]
            assert len(t) == 2 * len(want) + 1
            if s.min_rows > 2:  # in tiny leaves several columns cut alike
                assert sorted(inner["col"]) == sorted(c for c, _, _ in want)
        assert np.allclose([got[i][m] for i in own], 1 / (1 + np.exp(-margins[-1])), atol=1e-9)


def test_bins_hold_zero_and_quantiles(spark):
    X = np.zeros((300, 4))
    X[:, 0] = np.arange(300) - 100.0
    X[::2, 1] = 5.0
    X[:10, 2] = np.nan
    df = frame(spark, X, np.zeros(300), np.ones(300), np.zeros(300))
    b = B.fit_bins(df, "features", 16)
    edges = [b.edges[b.begin[c]:b.begin[c + 1]] for c in range(4)]
    assert all(0.0 in e for e in edges) and list(edges[1]) == [0.0, 5.0] and list(edges[2]) == list(edges[3]) == [0.0]
    counts = np.bincount(b.of(np.zeros(300, int), X[:, 0]))
    assert 14 <= len(edges[0]) <= 16 and counts.max() <= 30
    assert b.of(np.array([2, 1, 1, 0]), np.array([np.nan, 4.0, 9.0, 1e9])).tolist() == [0, 1, 1, len(edges[0]) - 1]


def test_a_model_ends_early_and_survives_its_table(spark):
    X, y, w = data(600)
    y = np.where(np.random.default_rng(3).random(600) < 0.25, 1 - y, y)  # noise to overfit
    df = frame(spark, X, y, np.ones(600), np.full(600, -1)).selectExpr("*", "i % 3 = 0 AS held")
    s = B.Boosting(rounds=40, step=0.5, leaves=20, min_rows=3, patience=3)
    (m,) = B.fit_boosted(df, settings=s, validation="held")
    assert 1 <= len(m.trees) < 37
    again = B.BoostedTrees.of_table(m.base, m.table())
    p = [[r.p[0] for r in B.score_boosted(df, [x], out="p").orderBy("i").select("p").collect()] for x in (m, again)]
    assert p[0] == p[1]
    v = np.arange(600) % 3 == 0
    base = np.full(600, 1 / (1 + np.exp(-m.base)))
    loss = lambda q: -np.mean(np.where(y[v] > 0, np.log(q[v]), np.log(1 - q[v])))
    assert loss(np.array(p[0])) < loss(base)


def test_defined_cases(spark):
    X, y, w = data(60)
    df = frame(spark, X, y, w, np.zeros(60))
    (m,) = B.fit_boosted(df.limit(0).unionByName(df.where("i < 3")), settings=B.Boosting(rounds=2))  # too few rows to split
    assert all(len(t) == 1 for t in m.trees)
    with pytest.raises(ValueError):
        B.fit_boosted(df.limit(0))
    (m,) = B.fit_boosted(df.withColumn("label", df.label * 0), settings=B.Boosting(rounds=2, min_rows=2))  # one class
    assert max(r.p[0] for r in B.score_boosted(df, [m], out="p").collect()) < 1e-3


def test_a_batch_looks_its_entries_up_once_for_all_trees(monkeypatch):
    """A pass that adds up the trees of many rounds costs no look-up of the entries for each round."""
    rng = np.random.default_rng(5)
    n, width = 50, 6
    bins = rng.integers(1, 5, (n, width)).astype(np.uint8)
    begin = np.arange(n + 1)
    cols = np.tile(np.arange(width, dtype=np.int32), n)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n)), pa.array(np.ones(n)), pa.array(np.full(n, -1, np.int32)), B.packed(cols, begin * width), B.packed(bins.ravel(), begin * width), B.packed(np.zeros(2 * n), begin * 2)],
        names=["y", "w", "fold", "cols", "bins", "margins"])

    def stump(col, at, low, high):
        return B.Tree(np.array([col, 0, 0]), np.array([at, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([0.0, low, high]))

    rounds = [[stump(c, 2, -0.5 - c, 0.25 * c), None if c == 3 else stump(width - 1 - c, 1, c, -c)] for c in range(4)]
    calls, dense = [], B.Rows.dense
    monkeypatch.setattr(B.Rows, "dense", lambda self, *a: calls.append(1) or dense(self, *a))
    margins, at = B.Rows(batch, 2).with_trees(rounds, np.zeros(width, np.uint8), [stump(5, 3, 0, 0)])
    want = np.zeros((n, 2))
    for trees in rounds:
        for m, t in enumerate(trees):
            if t is not None:
                want[:, m] += np.where(bins[:, t.col[0]] <= t.bin[0], t.value[1], t.value[2])
    assert np.array_equal(margins, want) and np.array_equal(at[0], np.where(bins[:, 5] <= 3, 1, 2))
    assert len(calls) == 1


WHOLE = B.Boosting(rounds=5, step=0.3, leaves=9, min_rows=5, bins=12)


def whole(monkeypatch):
    """Every fit grows its trees in one task; a pass over the rows fails."""
    monkeypatch.setattr(B, "WHOLE_ROUNDS", 0)
    monkeypatch.setattr(B, "_pass", lambda *a: pytest.fail("a pass was made"))


def margins_of(spark, df, models):
    return {r.i: r.p for r in B.score_boosted(df, models, out="p").select("i", "p").collect()}


@pytest.mark.parametrize("s", [WHOLE, B.Boosting(rounds=3, step=0.5, leaves=30, columns=1.0, min_rows=2, bins=200)], ids=["some", "many"])
def test_trees_grown_in_one_task_equal_a_plain_booster(spark, monkeypatch, s):
    whole(monkeypatch)
    X, y, w = data()
    fold = np.arange(len(y)) % 2
    df = frame(spark, X, y, w, fold)
    bins = B.fit_bins(df, "features", s.bins)
    models = B.fit_boosted(df, weight="weight", fold="fold", models=2, settings=s)
    got = margins_of(spark, df, models)
    for m in range(2):
        own = np.flatnonzero(fold != m)
        masks = [B.column_sample(X.shape[1], s.columns, s.seed, r, m) for r in range(s.rounds)]
        splits, margins = plain(X[own], y[own], w[own], bins, masks, s, models[m].base)
        assert [len(t) for t in models[m].trees] == [2 * len(want) + 1 for want in splits]
        assert np.allclose([got[i][m] for i in own], 1 / (1 + np.exp(-margins[-1])), atol=1e-9)


def test_one_task_and_passes_agree(spark, monkeypatch):
    X, y, w = data(500)
    X[7, 0], X[8:12] = np.nan, 0.0
    fold = np.where(np.arange(len(y)) % 7 == 0, -1, np.arange(len(y)) % 3)
    df = frame(spark, X, y, w, fold)
    by_pass = B.fit_boosted(df, weight="weight", fold="fold", models=3, settings=WHOLE)
    whole(monkeypatch)
    alone = B.fit_boosted(df, weight="weight", fold="fold", models=3, settings=WHOLE)
    again = [B.BoostedTrees.of_table(m.base, m.table()) for m in alone]
    a, b, c = (margins_of(spark, df, x) for x in (by_pass, alone, again))
    assert all(np.allclose(a[i], b[i], atol=1e-9) and b[i] == c[i] for i in a)
    own = {r.i: r.p for r in B.score_own(df, alone, "features", "fold", "p").collect()}
    assert own == {i: (None if fold[i] < 0 else b[i][fold[i]]) for i in b}


def test_a_model_grown_in_one_task_ends_early(spark, monkeypatch):
    X, y, w = data(600)
    y = np.where(np.random.default_rng(3).random(600) < 0.25, 1 - y, y)  # noise to overfit
    df = frame(spark, X, y, np.random.default_rng(4).uniform(0.5, 1.5, 600), np.full(600, -1)).selectExpr("*", "i % 3 = 0 AS held")
    s = B.Boosting(rounds=40, step=0.5, leaves=20, min_rows=3, patience=3)
    (by_pass,) = B.fit_boosted(df, weight="weight", settings=s, validation="held")
    whole(monkeypatch)
    (alone,) = B.fit_boosted(df, weight="weight", settings=s, validation="held")
    assert 1 <= len(alone.trees) < 37 and len(alone.trees) == len(by_pass.trees)
    a, b = (margins_of(spark, df, [x]) for x in (by_pass, alone))
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_defined_cases_in_one_task(spark, monkeypatch):
    whole(monkeypatch)
    X, y, w = data(60)
    df = frame(spark, X, y, w, np.zeros(60))
    (m,) = B.fit_boosted(df.where("i < 3"), settings=B.Boosting(rounds=2))  # too few rows to split
    assert [len(t) for t in m.trees] == [1, 1]
    (m,) = B.fit_boosted(df, fold="fold", settings=B.Boosting(rounds=2))  # no row to learn from
    assert [len(t) for t in m.trees] == [1, 1] and m.trees[-1]["value"].tolist() == [0.0]
    (m,) = B.fit_boosted(df.withColumn("label", df.label * 0), settings=B.Boosting(rounds=2, min_rows=2))  # one class
    assert max(r.p[0] for r in B.score_boosted(df, [m], out="p").collect()) < 1e-3
    with pytest.raises(IndexError):
        m.trees[2]


def test_more_than_a_task_may_hold_goes_through_the_passes(spark, monkeypatch):
    X, y, w = data(60)
    df = frame(spark, X, y, w, np.zeros(60))
    monkeypatch.setattr(B, "WHOLE_ROUNDS", 0)
    monkeypatch.setattr(B, "_grown_whole", lambda *a: pytest.fail("grown in one task"))
    for name, most in (("WHOLE_CELLS", 60 * X.shape[1] - 1), ("WHOLE_SUMS", 10)):
        with monkeypatch.context() as p:
            p.setattr(B, name, most)
            (m,) = B.fit_boosted(df, settings=B.Boosting(rounds=2, min_rows=5))
            assert len(m.trees) == 2


def test_trees_whose_children_stand_apart_are_scored_alike(spark):
    import pandas as pd
    apart = pd.DataFrame({"node": range(5), "col": [0, 1, -1, -1, -1], "threshold": [0.5, -1.0, 0, 0, 0], "left": [2, 3, -1, -1, -1], "right": [1, 4, -1, -1, -1], "value": [0, 0, 0.25, -0.5, 1.0]})
    x = np.array([[0.5, 9.0], [0.6, -1.0], [0.6, 0.0]])
    df = frame(spark, x, np.zeros(3), np.ones(3), np.zeros(3))
    got = margins_of(spark, df, [B.BoostedTrees(0.1, [apart, apart])])
    assert [got[i][0] for i in range(3)] == pytest.approx([1 / (1 + np.exp(-0.1 - 2 * v)) for v in (0.25, -0.5, 1.0)])
