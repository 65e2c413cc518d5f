"""Gradient boosting with vector leaves: one tree a round for all targets, grown level by level from histograms.

Features are cut into bins once, for all folds and settings. Rows of one place with the same bins get the same forecasts from every
tree, so they become one weighted row: how many they are, their mean targets, and the squares around these. That table is saved
once; it has no more rows than there are combinations of bins, however long the table is. A level is one job for all
models together: every task adds up, for each open node of each model, the gradients of all targets by (feature, bin);
Spark sums the tasks' histograms, and each node's best split is found in a task of its own. What reaches the driver is a
row a node. So the number of jobs is rounds times depth, whatever the number of folds and settings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Saved


@dataclass(frozen=True)
class Setting:
    """rounds at most, depth of a tree, learning rate, l2 on leaves, least rows of a leaf, rounds without a better validation error."""

    name: str
    rounds: int = 20
    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    least: int = 5
    patience: int | None = None


@dataclass
class Tree:
    """Node k has children 2k + 1 and 2k + 2. feature -1: a leaf. Bins up to `bin` go left; a missing value goes by `missing_left`."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends; bins: rows by features, 0 is missing."""
        node = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            inner = self.feature[node] >= 0
            own = bins[np.arange(len(bins)), np.maximum(self.feature[node], 0)]
            left = np.where(own == 0, self.missing_left[node], own <= self.bin[node])
            node = np.where(inner, 2 * node + np.where(left, 1, 2), node)
        return node


@dataclass
class Model:
    """One fit: rows with train[0] <= place <= train[1], judged on rows within val; other rows are never looked at."""

    name: str
    setting: Setting
    train: tuple[int, int]
    val: tuple[int, int] | None = None
    base: np.ndarray | None = None
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    @property
    def best(self) -> int:
        """Trees to keep: up to the least validation error, all without validation rows."""
        return int(np.argmin(self.errors)) if self.errors else len(self.trees)

    @property
    def done(self) -> bool:
        stale = self.setting.patience is not None and bool(self.errors) and len(self.errors) - 1 - self.best >= self.setting.patience
        return stale or len(self.trees) >= self.setting.rounds

    def raw(self, bins: np.ndarray, trees: Sequence[Tree] | None = None) -> np.ndarray:
        """Sum of the trees' leaf vectors."""
        out = np.zeros((len(bins), len(self.base)))
        for t in self.trees[: self.best] if trees is None else trees:
            out += t.value[t.leaves(bins)]
        return out


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 32, accuracy: int = 10_000) -> list[np.ndarray]:
    """Up to bins - 1 ascending edges of each feature, quantiles of its values, in one aggregation; nulls and NaN are left out."""
    steps = [k / bins for k in range(1, bins)]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    row = df.agg(*[F.percentile_approx(value(c), steps, accuracy).alias(f"e{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(row[f"e{k}"] or [], float)) for k in range(len(features))]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value, from 1: how many edges lie below it. 0 for NaN."""
    cols = [np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(e, x[:, k], "left")) for k, e in enumerate(edges)]
    return np.stack(cols, 1).astype(np.uint8)


def _matrix(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    return np.stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in columns], 1)


def _bytes(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    width = a.dtype.itemsize * a.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(a)])


def _array(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), dtype)
    _, offsets, data = column.cast(pa.binary()).buffers()
    return np.frombuffer(data, dtype, len(column) * width, np.frombuffer(offsets, np.int32)[column.offset]).reshape(-1, width)


def binned(df: DataFrame, features: Sequence[str], targets: Sequence[str], place: str, edges: list[np.ndarray]) -> DataFrame:
    """(place, x, y0, y1, ..): bins and targets of the rows with a place and all targets, a byte a feature."""
    nf, names = len(features), [f"y{t}" for t in range(len(targets))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = to_bins(_matrix(batch, range(1, nf + 1)), edges), _matrix(batch, range(nf + 1, batch.num_columns))
            keep = np.isfinite(y).all(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), _bytes(x[keep]), *map(pa.array, y[keep].T)], names=["place", "x", *names])

    whole = df.where(F.col(place).isNotNull()).select(F.col(place).cast("long").alias("place"), *[F.col(c).cast("double") for c in (*features, *targets)])
    return whole.mapInArrow(run, "place long, x binary, " + ", ".join(f"{c} double" for c in names))


def combined(rows: DataFrame, n_targets: int) -> DataFrame:
    """(place, x, n, spread, y0, y1, ..): a row for all rows of one place and the same bins, with their mean targets and the sum of
    squares around these over all targets. Gradient sums and squared errors of any forecast follow from it alone."""
    names = [f"y{t}" for t in range(n_targets)]
    spread = sum((F.var_pop(c) for c in names), F.lit(0.0)) * F.count("*")
    return rows.groupBy("place", "x").agg(F.count("*").cast("double").alias("n"), spread.alias("spread"), *[F.avg(c).alias(c) for c in names])


def split_gains(n: np.ndarray, g: np.ndarray, l2: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Gains of every split of one node, by (missing goes left, feature, bin), and the node's own score. n: (features, bins), g:
    (features, bins, targets); bin 0 is missing. A gain is the sum over targets of G^2 / (n + l2) of both sides, less the
    node's; sides of fewer than `least` rows have -inf."""
    score = lambda n, g: (g * g).sum(-1) / np.maximum(n + l2, 1e-12)
    total_n, total_g = n.sum(1)[:, None], g.sum(1)[:, None]
    out = []
    for missing_left in (False, True):
        left_n, left_g = np.cumsum(n[:, 1:], 1), np.cumsum(g[:, 1:], 1)
        if missing_left:
            left_n, left_g = left_n + n[:, :1], left_g + g[:, :1]
        right_n, right_g = total_n - left_n, total_g - left_g
        gain = score(left_n, left_g) + score(right_n, right_g) - score(total_n, total_g)
        out.append(np.where((left_n >= least) & (right_n >= least), gain, -np.inf))
    return np.stack(out), score(total_n[0, 0], total_g[0, 0])


class Fit:
    """All models over one saved table of weighted rows."""

    def __init__(self, table: DataFrame, models: list[Model], n_features: int, n_targets: int, n_bins: int):
        self.table, self.models, self.nf, self.nt, self.nb = table, models, n_features, n_targets, n_bins + 1

    def means(self) -> None:
        """The base of each model: the mean of its training rows."""
        nt, spans = self.nt, [m.train for m in self.models]

        def run(batches):
            n, s = np.zeros(len(spans)), np.zeros((len(spans), nt))
            for batch in batches:
                at, w, y = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch, range(4, 4 + nt))
                for k, (lo, hi) in enumerate(spans):
                    mine = (at >= lo) & (at <= hi)
                    n[k] += w[mine].sum()
                    s[k] += w[mine] @ y[mine]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(spans)), pa.int32()), pa.array(n), *[pa.array(s[:, t]) for t in range(nt)]], names=["model", "n", *[f"s{t}" for t in range(nt)]])

        parts = self.table.mapInArrow(run, "model int, n double, " + ", ".join(f"s{t} double" for t in range(nt)))
        for r in parts.groupBy("model").agg(F.sum("n").alias("n"), *[F.sum(f"s{t}").alias(f"s{t}") for t in range(nt)]).collect():
            self.models[r.model].base = np.array([r[f"s{t}"] / max(r.n, 1) for t in range(nt)])

    def level(self, live: list[int], growing: dict[int, Tree], level: int) -> dict[tuple[int, int], dict]:
        """Best split of each node of the level, by (model, node), and at the first level each model's validation error so far."""
        nf, nt, nb, models = self.nf, self.nt, self.nb, [self.models[k] for k in live]
        trees, first, width = [growing[k] for k in live], (1 << level) - 1, 1 << level
        fields = ["model", "node", "feature", "bin", "n", *[f"g{t}" for t in range(nt)]]

        def run(batches):
            hist = np.zeros((len(models), width * nf * nb, nt + 1))
            errors = np.zeros((len(models), 2))
            offset = np.arange(nf) * nb
            for batch in batches:
                at, x, w, spread, y = batch.column(0).to_numpy(), _array(batch.column(1), "u1", nf), batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch, range(4, 4 + nt))
                for k, (m, tree) in enumerate(zip(models, trees, strict=True)):
                    mine = np.flatnonzero((at >= m.train[0]) & (at <= m.train[1]))
                    node = tree.leaves(x[mine]) - first
                    mine, node = mine[node >= 0], node[node >= 0]  # a leaf further up takes no more splits
                    grad = w[mine, None] * (m.base + m.raw(x[mine], m.trees) - y[mine])
                    cell = (node[:, None] * (nf * nb) + offset + x[mine]).ravel()
                    hist[k, :, 0] += np.bincount(cell, np.repeat(w[mine], nf), hist.shape[1])
                    for t in range(nt):
                        hist[k, :, t + 1] += np.bincount(cell, np.repeat(grad[:, t], nf), hist.shape[1])
                    if level == 0 and m.val:
                        held = np.flatnonzero((at >= m.val[0]) & (at <= m.val[1]))
                        errors[k] += w[held] @ ((m.base + m.raw(x[held], m.trees) - y[held]) ** 2).sum(1) + spread[held].sum(), w[held].sum() * nt
            k, cell = np.nonzero(hist[:, :, 0])
            columns = [k, first + cell // (nf * nb), cell // nb % nf, cell % nb, *hist[k, cell].T]
            extra = [np.flatnonzero(errors[:, 1]), *([np.full((errors[:, 1] > 0).sum(), -1)] * 3), errors[errors[:, 1] > 0, 1], errors[errors[:, 1] > 0, 0], *([np.zeros((errors[:, 1] > 0).sum())] * (nt - 1))]
            both = [np.concatenate([a, b]) for a, b in zip(columns, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i < 4 else c.astype(float)) for i, c in enumerate(both)], names=fields)

        settings = [m.setting for m in models]

        def best(table: pa.Table) -> pa.Table:
            model, node = table["model"][0].as_py(), table["node"][0].as_py()
            f, b, n = (table[c].to_numpy() for c in ("feature", "bin", "n"))
            g = np.stack([table[f"g{t}"].to_numpy() for t in range(nt)], 1)
            if node < 0:
                row = [-1, -1, False, -np.inf, n[0], 0.0, g[0].tolist(), g[0].tolist()]
            else:
                ns, gs = np.zeros((nf, nb)), np.zeros((nf, nb, nt))
                ns[f, b], gs[f, b] = n, g
                gains, _ = split_gains(ns, gs, settings[model].l2, settings[model].least)
                # sums come in any order: of gains that are equal but for rounding, the first one
                side, feature, cut = np.unravel_index(int((gains >= gains.max() - 1e-9 * abs(gains.max())).argmax()) if np.isfinite(gains.max()) else 0, gains.shape)
                left = np.arange(nb) <= cut + 1
                left[0] = bool(side)
                row = [int(feature), int(cut + 1), bool(side), float(gains[side, feature, cut]), float(ns[0].sum()), float(ns[feature, left].sum()), gs[0].sum(0).tolist(), gs[feature, left].sum(0).tolist()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.table([pa.array([v], k) for v, k in zip([model, node, *row], kinds, strict=True)], names=["model", "node", "feature", "cut", "side", "gain", "n", "n_left", "g", "g_left"])

        parts = self.table.mapInArrow(run, "model int, node int, feature int, bin int, n double, " + ", ".join(f"g{t} double" for t in range(nt)))
        whole = parts.groupBy("model", "node", "feature", "bin").agg(F.sum("n").alias("n"), *[F.sum(f"g{t}").alias(f"g{t}") for t in range(nt)])
        found = whole.groupBy("model", "node").applyInArrow(best, "model int, node int, feature int, cut int, side boolean, gain double, n double, n_left double, g array<double>, g_left array<double>")
        return {(live[r.model], r.node): r for r in found.collect()}

    def judge(self) -> None:
        """The validation error of the last round's trees, which no later round looks at."""
        last, nf, nt = [m for m in self.models if m.val and len(m.errors) == len(m.trees)], self.nf, self.nt

        def run(batches):
            errors = np.zeros((len(last), 2))
            for batch in batches:
                at, x, w, spread, y = batch.column(0).to_numpy(), _array(batch.column(1), "u1", nf), batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch, range(4, 4 + nt))
                for k, m in enumerate(last):
                    held = np.flatnonzero((at >= m.val[0]) & (at <= m.val[1]))
                    errors[k] += w[held] @ ((m.base + m.raw(x[held], m.trees) - y[held]) ** 2).sum(1) + spread[held].sum(), w[held].sum() * nt
            yield pa.RecordBatch.from_arrays([pa.array(range(len(last)), pa.int32()), pa.array(errors[:, 0]), pa.array(errors[:, 1])], names=["model", "e", "n"])

        if last:
            for r in self.table.mapInArrow(run, "model int, e double, n double").groupBy("model").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).where("n > 0").collect():
                last[r.model].errors.append(float(np.sqrt(r.e / r.n)))

    def round(self, live: list[int]) -> None:
        """One more tree for each live model; validation errors are those before it."""
        growing, depth = {}, max(self.models[k].setting.depth for k in live)
        for k in live:
            size = (1 << (self.models[k].setting.depth + 1)) - 1
            growing[k] = Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size, bool), np.zeros((size, self.nt)), np.zeros(size))
        for level in range(depth):
            at = [k for k in live if level < self.models[k].setting.depth]
            for (k, node), r in self.level(at, growing, level).items():
                s, tree = self.models[k].setting, growing[k]
                if node < 0:
                    self.models[k].errors.append(float(np.sqrt(r.g[0] / r.n)))
                    continue
                leaf = lambda g, n: -s.rate * np.array(g) / (n + s.l2)
                tree.value[node] = leaf(r.g, r.n)
                if r.gain > 1e-12:
                    tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = r.feature, r.cut, r.side, r.gain
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = leaf(r.g_left, r.n_left), leaf(np.array(r.g) - np.array(r.g_left), r.n - r.n_left)
        for k in live:
            self.models[k].trees.append(growing[k])


def fit(df: DataFrame, features: Sequence[str], targets: Sequence[str], models: list[Model], place: str = "i", bins: int = 32, edges: list[np.ndarray] | None = None, saved: Saved | None = None) -> list[np.ndarray]:
    """Fits every model to df's rows (by place) and gives the bin edges, which predictions need.

    Squared error of all targets, a leaf's vector is -rate * gradient sum / (rows + l2). Rows without a place, or with a null,
    NaN or infinite target, take no part; a null or NaN feature has a bin of its own that goes to the better side. At most
    254 bins. Edges are taken over the rows that some model trains on, unless given. Models stop by themselves: after their
    rounds, or when their validation error hasn't fallen for `patience` rounds. An empty table gives models without effect.
    """
    own = saved or Saved(df.sparkSession, "boosting")
    if edges is None:
        inside = F.lit(False)
        for m in models:
            inside = inside | F.col(place).between(*m.train)
        edges = bin_edges(df.where(inside), features, bins)
    table = own.save(combined(binned(df, features, targets, place, edges), len(targets)))
    run = Fit(table, models, len(features), len(targets), bins)
    for m in models:
        m.base = np.zeros(len(targets))
    run.means()
    while live := [k for k, m in enumerate(models) if not m.done]:
        run.round(live)
    run.judge()
    own.drop(table)
    return edges


def predict(df: DataFrame, features: Sequence[str], model: Model, edges: list[np.ndarray], names: Sequence[str]) -> DataFrame:
    """df with one column a target: base and trees up to the best round; a null row of features is predicted like any other."""
    keep = Model(model.name, model.setting, model.train, None, model.base, model.trees[: model.best])

    @F.pandas_udf("array<double>")
    def run(*columns):
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        import pandas as pd

        return pd.Series(list(keep.base + keep.raw(to_bins(x, edges))))

    out = df.withColumn("_forecast", run(*[F.col(c).cast("double") for c in features]))
    return out.select(*df.columns, *[F.col("_forecast")[k].alias(n) for k, n in enumerate(names)])


def importance(model: Model, features: Sequence[str]) -> dict[str, float]:
    """Summed gain of each feature over the kept trees, over all targets together."""
    out = dict.fromkeys(features, 0.0)
    for t in model.trees[: model.best]:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                out[features[f]] += float(g)
    return out
