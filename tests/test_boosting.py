"""Vector-leaf boosting against plain NumPy: every split by trying all, whole forests, early stopping and unseen validation rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import boosting as B

FEATURES, TARGETS = ["a", "b", "c", "d"], ["y1", "y2", "y3"]


def made(n=900, seed=3):
    rng = np.random.RandomState(seed)
    x = np.round(rng.randn(n, 4), 2)
    x[:, 3] = rng.randint(0, 3, n)
    x[rng.rand(n, 4) < 0.05] = np.nan
    z = np.nan_to_num(x)
    y = np.stack([z[:, 0] * (z[:, 1] > 0), np.sin(2 * z[:, 0]) + np.isnan(x[:, 1]), z[:, 3] - z[:, 0]], 1) + 0.2 * rng.randn(n, 3)
    return x, y


def frame(spark, x, y):
    rows = [(i, *(None if np.isnan(v) and i % 2 else float(v) for v in r), *map(float, t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in FEATURES + TARGETS)).repartition(5)


def plain_tree(bins, grad, s, node=0, level=0, rows=None, out=None):
    """A tree by trying every split on the rows themselves: {node: (feature, cut, missing left, gain)} and {leaf: vector}."""
    rows, out = np.arange(len(bins)) if rows is None else rows, {} if out is None else out
    leaf = -s.rate * grad[rows].sum(0) / (len(rows) + s.l2)
    score = lambda r: (grad[r].sum(0) ** 2).sum() / (len(r) + s.l2)
    best = (1e-12, None)
    if level < s.depth:
        for miss in (False, True):
            for f in range(bins.shape[1]):
                for cut in range(1, bins.max() + 1):
                    own = bins[rows, f]
                    left = np.where(own == 0, miss, own <= cut)
                    a, b = rows[left], rows[~left]
                    if len(a) >= s.least and len(b) >= s.least and (g := score(a) + score(b) - score(rows)) > best[0] + 1e-9:
                        best = (g, (f, cut, miss, a, b))
    if best[1] is None:
        out[node] = (-1, leaf)
        return out
    f, cut, miss, a, b = best[1]
    out[node] = (f, best[0])
    plain_tree(bins, grad, s, 2 * node + 1, level + 1, a, out)
    plain_tree(bins, grad, s, 2 * node + 2, level + 1, b, out)
    return out


def test_trees_equal_all_splits_tried(spark):
    x, y = made()
    s = B.Setting("s", rounds=3, depth=3, rate=0.4, l2=2.0, least=10)
    model = B.Model("m", s, (0, 699), (700, 899))
    edges = B.fit(frame(spark, x, y), FEATURES, TARGETS, [model], bins=8)
    bins, f = B.to_bins(x, edges), np.repeat(y[:700].mean(0)[None], 900, 0)
    assert model.base == pytest.approx(y[:700].mean(0)) and len(model.trees) == 3
    for k, tree in enumerate(model.trees):
        assert model.errors[k] == pytest.approx(np.sqrt(((f[700:] - y[700:]) ** 2).mean()))
        want = plain_tree(bins[:700], f[:700] - y[:700], s)
        for node, (feature, value) in want.items():
            assert tree.feature[node] == feature
            assert (tree.value[node] if feature < 0 else tree.gain[node]) == pytest.approx(value)
        f += tree.value[tree.leaves(bins)]


def test_many_models_in_one_pass_equal_single_fits_and_never_see_validation_rows(spark):
    x, y = made()
    spans = [((0, 299), (300, 399)), ((100, 499), (500, 649)), ((200, 499), None)]
    settings = [B.Setting("p", rounds=4, depth=2, rate=0.5), B.Setting("q", rounds=9, depth=3, rate=1.0, l2=0.0, least=1, patience=1)]
    make = lambda: [B.Model(f"{s.name}{k}", s, *span) for s in settings for k, span in enumerate(spans)]
    df, together = frame(spark, x, y), make()
    edges = B.fit(df, FEATURES, TARGETS, together, bins=6)
    for m, alone in list(zip(together, make(), strict=True))[::3]:
        B.fit(df, FEATURES, TARGETS, [alone], edges=edges, bins=6)
        assert len(m.trees) == len(alone.trees) and all((a.feature == b.feature).all() and np.allclose(a.value, b.value) for a, b in zip(m.trees, alone.trees, strict=True))
    assert any(len(m.trees) < m.setting.rounds for m in together)  # patience ended some
    assert all(len(m.errors) == len(m.trees) + 1 for m in together if m.val)
    other = y.copy()
    other[650:] += 100
    for m, again in zip(together, changed := make(), strict=True):
        assert m.name == again.name
    B.fit(frame(spark, x, other), FEATURES, TARGETS, changed, edges=edges, bins=6)
    assert all(np.allclose(a.value, b.value) for m, n in zip(together, changed, strict=True) for a, b in zip(m.trees, n.trees, strict=True))


def test_one_forest_forecasts_no_worse_than_single_target_forests(spark):
    """Targets of one cause, as the steps of a horizon are: what they share tells the splits from noise."""
    x, y = made(1200, 8)
    y = y[:, :1] * np.array([1.0, 0.8, -1.2]) + 0.6 * np.random.RandomState(1).randn(1200, 3)
    df, s = frame(spark, x, y), B.Setting("s", rounds=12, depth=3, rate=0.3)
    error = []
    joint = B.Model("joint", s, (0, 899))
    edges = B.fit(df, FEATURES, TARGETS, [joint], bins=16)
    got = B.predict(df.where("i >= 900"), FEATURES, joint, edges, ["f1", "f2", "f3"])
    assert got.columns == [*df.columns, "f1", "f2", "f3"]
    joint_error = got.agg(*[F.avg(F.pow(F.col(f"y{k}") - F.col(f"f{k}"), 2)) for k in (1, 2, 3)]).first()
    for k, t in enumerate(TARGETS):
        m = B.Model(t, s, (0, 899))
        B.fit(df, FEATURES, [t], [m], edges=edges, bins=16)
        error.append(B.predict(df.where("i >= 900"), FEATURES, m, edges, ["f"]).agg(F.avg(F.pow(F.col(t) - F.col("f"), 2))).first()[0])
    assert sum(joint_error) <= 1.02 * sum(error) and sum(joint_error) < 0.9 * y[900:].var(0).sum()
    shares = B.importance(joint, FEATURES)
    assert shares["a"] == max(shares.values())


def test_rows_of_the_same_bins_are_saved_once_and_count_as_often_as_they_are(spark, monkeypatch):
    x, y = made(300)
    rng = np.random.RandomState(2)
    x, y = np.repeat(x, 12, 0), np.repeat(y, 12, 0) + rng.randn(3600, 3)
    place, saved = np.tile([0] * 9 + [1] * 3, 300), []
    rows = [(int(p), *(None if np.isnan(v) else float(v) for v in r), *map(float, t)) for p, r, t in zip(place, x, y, strict=True)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in FEATURES + TARGETS)).repartition(5)
    keep = B.Saved.save
    monkeypatch.setattr(B.Saved, "save", lambda self, d: saved.append((out := keep(self, d)).count()) or out)
    s = B.Setting("s", rounds=2, depth=3, rate=0.4, l2=2.0, least=10)
    model = B.Model("m", s, (0, 0), (1, 1))
    edges = B.fit(df, FEATURES, TARGETS, [model], bins=8)
    assert saved[0] <= 600  # 300 different rows in two places
    bins, train = B.to_bins(x, edges), place == 0
    f = np.repeat(y[train].mean(0)[None], len(x), 0)
    for k, tree in enumerate(model.trees):
        assert model.errors[k] == pytest.approx(np.sqrt(((f - y)[~train] ** 2).mean()))
        for node, (feature, value) in plain_tree(bins[train], (f - y)[train], s).items():
            assert tree.feature[node] == feature and (tree.value[node] if feature < 0 else tree.gain[node]) == pytest.approx(value)
        f += tree.value[tree.leaves(bins)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "i long, a double, y1 double")
    m = B.Model("m", B.Setting("s", rounds=2), (0, 9))
    edges = B.fit(empty, ["a"], ["y1"], [m])
    assert B.predict(empty, ["a"], m, edges, ["f"]).count() == 0
    rows = spark.createDataFrame([(0, 1.0, 2.0), (None, 1.0, 9.0), (1, None, 4.0), (2, 3.0, None), (3, 3.0, float("nan"))], "i long, a double, y1 double")
    m = B.Model("m", B.Setting("s", rounds=2), (0, 9))
    edges = B.fit(rows, ["a"], ["y1"], [m])
    assert m.base.tolist() == [3.0] and [r.f for r in B.predict(rows, ["a"], m, edges, ["f"]).collect()] == [3.0] * 5
