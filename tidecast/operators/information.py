"""Mutual information of continuous columns by k nearest neighbours, counted exactly over the whole table.

Both columns are divided by their deviation and put on a fine integer grid, so all distances are exact. Equal points are one
point with a weight. A k-d tree over a bounded sample deals points to leaves of about equal size, and a leaf's points lie in
small cells: a point finds its k nearest in its own cell, then in the cells of its leaf that its box of that radius meets, and
then, if the box reaches out of the leaf, in the other leaves that it meets. How many values of one column lie closer than
the k-th neighbour is a difference of two running counts along that column. Its values are dealt into ranges, and a point
whose two counts lie in one range is settled there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Saved

GRID = 1 << 24
#: Points of a leaf, leaves at most, and points that are sampled for each leaf (so at most 524,288 reach the driver).
LEAF, LEAVES, SAMPLED = 8192, 16_384, 16
#: Points of a cell in a leaf, and pairs of points that are compared at once.
CELL, PAIRS = 32, 1 << 18
#: Ranges of a column at least and at most, points of a range between them, and points that are sampled for each.
RANGES, MOST, ROWS, DRAWN = 64, 4096, 131_072, 64
FAR = np.iinfo(np.int64).max // 8
EULER = 0.57721566490153286061


def digamma(n: Column) -> Column:
    """Of whole numbers from 1: a table up to 12, then the asymptotic series (to 1e-11)."""
    table = F.array(*[F.lit(float(sum(1 / i for i in range(1, k)) - EULER)) for k in range(1, 13)])
    x = n.cast("double")
    return F.when(n <= 12, F.element_at(table, F.least(n, F.lit(12)).cast("int"))).otherwise(F.ln(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6)))


def psi(n: np.ndarray) -> np.ndarray:
    """digamma() of an array."""
    table, x = np.array([0.0, *(sum(1 / i for i in range(1, k)) - EULER for k in range(1, 13))]), np.maximum(n, 1).astype(float)
    return np.where(n <= 12, table[np.clip(n, 0, 12)], np.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4) - 1 / (252 * x**6))


class Leaves:
    """A k-d tree: inner node n splits its wider axis at a sampled median; lo and hi are the leaves' boxes."""

    def __init__(self, sample: np.ndarray, depth: int):
        far = np.iinfo(np.int64).max // 4
        self.depth, n = depth, 1 << depth
        self.axis, self.cut = np.zeros(n, int), np.zeros(n, np.int64)
        parts, boxes = {1: sample}, {1: (np.full(2, -far), np.full(2, far))}
        for node in range(1, n):
            rows, (lo, hi) = parts.pop(node), boxes.pop(node)
            if len(rows):
                # the axis along which the sample splits best: ties can make one axis useless
                cuts = [int(np.median(rows[:, a])) for a in (0, 1)]
                spread = [min((rows[:, a] <= cuts[a]).sum(), (rows[:, a] > cuts[a]).sum()) for a in (0, 1)]
                wide = np.ptp(rows.astype(float), axis=0)
                self.axis[node] = a = int(max((0, 1), key=lambda a: (spread[a] > 0.25 * len(rows), wide[a])))
                # halfway to the next value, as a box that ends at a common value is left by all its points' own boxes
                above = rows[rows[:, a] > cuts[a], a]
                self.cut[node] = cuts[a] + ((above.min() - cuts[a]) // 2 if len(above) else 0)
            a, c = self.axis[node], self.cut[node]
            left = rows[:, a] <= c if len(rows) else np.zeros(0, bool)
            parts[2 * node], parts[2 * node + 1] = rows[left], rows[~left]
            below, above = hi.copy(), lo.copy()
            below[a], above[a] = min(hi[a], c), max(lo[a], c + 1)
            boxes[2 * node], boxes[2 * node + 1] = (lo, below), (above, hi)
        self.lo, self.hi = (np.array([boxes[n + i][e] for i in range(n)]) for e in (0, 1))

    def of(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def met(self, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves whose box the square of half-width r around a point meets."""
        row, node = np.arange(len(p)), np.ones(len(p), np.int64)
        for _ in range(self.depth):
            at, cut = p[row, self.axis[node]], self.cut[node]
            left, right = at - r[row] <= cut, at + r[row] > cut
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node - (1 << self.depth)


class Cells:
    """Points of a leaf (p, with weights w) in cells of one size, halved along the wider axis; lo and hi are the boxes of a cell's points.

    The last point fills up the cells, with weight 0. `at` has the points' rows, from len(p) for those that fill up.
    """

    def __init__(self, p: np.ndarray, w: np.ndarray, size: int):
        depth = max(0, int(np.ceil(np.log2(max(1, len(p)) / size))))
        rows = np.arange(-(-len(p) // (1 << depth)) << depth)
        p, w, at = p[np.minimum(rows, len(p) - 1)], np.where(rows < len(p), w[np.minimum(rows, len(p) - 1)], 0), rows[None, :]
        for _ in range(depth):
            axis = np.ptp(p[at], axis=1).argmax(1)
            order = np.argsort(p[at, axis[:, None]], 1)
            at = np.take_along_axis(at, order, 1).reshape(2 * len(at), -1)
        self.at, self.p, self.w = at, p[at], w[at]
        self.lo, self.hi = self.p.min(1), self.p.max(1)

    def meets(self, p: np.ndarray, r: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether points closer than r may lie in the cell."""
        reach = np.maximum(r - 1, -1)[..., None]
        return ((p + reach >= self.lo[cell]) & (p - reach <= self.hi[cell])).all(-1)

    def closer(self, p: np.ndarray, r: np.ndarray, row: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, distance, weight) of the k nearest of each p[row] in the cells paired with it that are closer than r; equal points left out."""
        out = [np.zeros(0, np.int64)] * 3
        step = max(1, PAIRS // self.p.shape[1])
        for s in range(0, len(row), step):
            i, c = row[s : s + step], cell[s : s + step]
            gap = np.maximum(np.abs(p[i, 0, None] - self.p[c, :, 0]), np.abs(p[i, 1, None] - self.p[c, :, 1]))
            a, b = np.nonzero((gap > 0) & (gap < r[i, None]) & (self.w[c] > 0))
            out = _least(*(np.concatenate(x) for x in zip(out, (i[a], gap[a, b], self.w[c[a], b]), strict=True)), k)
        return out


def _least(row: np.ndarray, d: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each row with the least d, by row and d."""
    order = np.lexsort((d, row))
    row, d, w = row[order], d[order], w[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], d[keep], w[keep]


def _radius(d: np.ndarray, w: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Distance of the k-th neighbour: own - 1 copies lie at 0, then neighbours (a row each, ascending, FAR and 0 where there are no more); -1 if there are fewer than k."""
    reached = ((own - 1)[:, None] + np.cumsum(w, 1) >= k) & (w > 0)
    return np.where(own > k, 0, np.where(reached.any(1), d[np.arange(len(d)), reached.argmax(1)], -1))


def _home(p: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Radius of each point of a leaf among the leaf's points, and distances and weights of its k nearest as in _radius()."""
    cells = Cells(p, own, max(CELL, 4 * k))
    count, size = cells.at.shape
    filled, k2 = cells.at.max() + 1, min(k, size)
    d, m = np.full((filled, k), FAR), np.zeros((filled, k), np.int64)
    step = max(1, PAIRS // size**2)
    for s in range(0, count, step):
        q, w, at = cells.p[s : s + step], cells.w[s : s + step], cells.at[s : s + step]
        gap = np.maximum(np.abs(q[:, :, None, 0] - q[:, None, :, 0]), np.abs(q[:, :, None, 1] - q[:, None, :, 1]))
        gap[(gap == 0) | (w == 0)[:, None, :]] = FAR
        near = np.argpartition(gap, k2 - 1, 2)[:, :, :k2]
        g, w = np.take_along_axis(gap, near, 2), np.take_along_axis(w[:, None, :], near, 2)
        order = np.argsort(g, 2)
        g, w = np.take_along_axis(g, order, 2), np.take_along_axis(w, order, 2)
        d[at, :k2], m[at, :k2] = g, np.where(g < FAR, w, 0)
    d, m = d[: len(p)], m[: len(p)]
    r = _radius(d, m, own, k)
    bound = np.where(r < 0, FAR, r)
    # which cells a cell's points may reach at all, and then which of its points do
    held = np.append(bound, np.zeros(filled - len(p), np.int64))[cells.at]
    most = np.maximum(held.max(1) - 1, -1)[:, None, None]
    a, b = np.nonzero(((cells.hi[:, None] + most >= cells.lo[None]) & (cells.lo[:, None] - most <= cells.hi[None])).all(2) & ~np.eye(count, dtype=bool))
    rows, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, PAIRS // size)
    for s in range(0, len(a), step):
        x, y = a[s : s + step], b[s : s + step]
        pair, i = np.nonzero(cells.meets(cells.p[x], held[x], y[:, None]) & (held[x] > 1))
        rows.append(cells.at[x[pair], i])
        others.append(y[pair])
    more = cells.closer(p, bound, np.concatenate(rows), np.concatenate(others), k)
    some = np.unique(more[0])
    mine = np.repeat(some, k), d[some].ravel(), m[some].ravel()
    row, gap, w = _least(*(np.concatenate(x) for x in zip(mine, more, strict=True)), k)
    at = np.arange(len(row)) - np.searchsorted(row, row)
    d[row, at], m[row, at] = gap, w
    return _radius(d, m, own, k), d, m


def _two(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], 1)


def _lists(n: int, row: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Entries by row as lists of n rows."""
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _radii(points: DataFrame, n: int, k: int, saved: Saved) -> DataFrame:
    """(x, y, m, r) of distinct points: r is the distance of the k-th neighbour."""
    leaves = min(LEAVES, max(1, n // LEAF))
    depth = max(0, int(np.ceil(np.log2(leaves))))
    share = min(1.0, SAMPLED * (1 << depth) / max(1, n))
    drawn = points.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("x", "y").limit(2 * SAMPLED << depth)
    tree = Leaves(np.array([(r.x, r.y) for r in drawn.collect()], np.int64).reshape(-1, 2), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.of(_two(b)))], names=["x", "y", "m", "leaf"])

    dealt = saved.save(points.select("x", "y", "m").mapInArrow(deal, "x long, y long, m long, leaf long"))

    def home(t: pa.Table) -> pa.Table:
        p, own = _two(t), t["m"].to_numpy()
        r, d, w = _home(p, own, k)
        leaf, reach = t["leaf"][0].as_py(), np.maximum(r - 1, 0)[:, None]
        opened = (r < 0) | ((p - reach < tree.lo[leaf]) | (p + reach > tree.hi[leaf])).any(1)
        row, at = np.nonzero((w > 0) & opened[:, None])  # the others need no candidates any more
        lists = _lists(len(p), row, d[row, at], w[row, at])
        return pa.table({"x": t["x"], "y": t["y"], "m": t["m"], "leaf": t["leaf"], "r": pa.array(r), "open": pa.array(opened), "d": lists[0], "w": lists[1]})

    first = saved.save(dealt.groupBy("leaf").applyInArrow(home, "x long, y long, m long, leaf long, r long, open boolean, d array<long>, w array<long>"))
    asking = first.where("open")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, own, r = _two(b), b.column("leaf").to_numpy(), b.column("r").to_numpy()
            r = np.where(r < 0, FAR, r)
            row, leaf = tree.met(p, r - 1)
            keep = leaf != own[row]
            row, leaf = row[keep], leaf[keep]
            yield pa.RecordBatch.from_arrays([pa.array(p[row, 0]), pa.array(p[row, 1]), pa.array(r[row]), pa.array(leaf)], names=["x", "y", "r", "leaf"])

    visits = asking.select("x", "y", "leaf", "r").mapInArrow(others, "x long, y long, r long, leaf long")

    def visit(asks: pa.Table, held: pa.Table) -> pa.Table:
        row = d = w = np.zeros(0, np.int64)
        p = _two(asks)
        if len(asks) and len(held):
            cells, r = Cells(_two(held), held["m"].to_numpy(), max(CELL, 4 * k)), asks["r"].to_numpy()
            every, step, met = np.arange(len(cells.at)), max(1, PAIRS // len(cells.at)), []
            for s in range(0, len(p), step):
                i, c = np.nonzero(cells.meets(p[s : s + step, None], r[s : s + step, None], every[None]))
                met.append((i + s, c))
            row, d, w = cells.closer(p, r, *(np.concatenate(x) for x in zip(*met, strict=True)), k)
        some = np.unique(row)
        lists = _lists(len(some), np.searchsorted(some, row), d, w)
        return pa.table({"x": pa.array(p[some, 0]), "y": pa.array(p[some, 1]), "d": lists[0], "w": lists[1]})

    more = visits.groupBy("leaf").cogroup(dealt.groupBy("leaf")).applyInArrow(visit, "x long, y long, d array<long>, w array<long>")
    both = asking.select("x", "y", "m", "d", "w").unionByName(more.withColumn("m", F.lit(None).cast("long")))
    near = both.groupBy("x", "y").agg(F.max("m").alias("m"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "w")))).alias("near"))  # k for each leaf met
    # the first distance at which own copies and neighbours so far are k
    state = F.struct((F.col("m") - 1).alias("n"), F.lit(None).cast("long").alias("r"))
    found = F.aggregate("near", state, lambda s, p: F.struct((s["n"] + p["w"]).alias("n"), F.coalesce(s["r"], F.when(s["n"] + p["w"] >= k, p["d"])).alias("r")))["r"]
    out = saved.save(first.where("NOT open").select("x", "y", "m", "r").unionByName(near.select("x", "y", "m", found.alias("r"))))
    saved.drop(dealt), saved.drop(first)
    return out


def _margin(points: DataFrame, axis: str, n: int, saved: Saved) -> float:
    """Sum over all rows of psi(a + 1), where a counts the other rows whose value on the axis lies closer than r (equal ones if r is 0).

    Cut points of a sample make ranges of about equal numbers of points, which are their values too. A range that holds a commoner
    value is dealt to several parts, each with all of the range's values, which are few then. Only a point whose box ends in
    two ranges is put together from two counts and the weights of the ranges between them.
    """
    ranges = max(RANGES, min(MOST, n // ROWS))
    drawn = points.select(axis).sample(fraction=min(1.0, DRAWN * ranges / max(1, n)), seed=1).limit(2 * DRAWN * ranges).collect()
    drawn = np.sort(np.array([r[0] for r in drawn], np.int64))
    cuts, slots = np.unique(drawn[[len(drawn) * i // ranges for i in range(1, ranges)]] if len(drawn) else drawn, return_counts=True)
    copies = np.append(1, slots)  # parts of each range
    # halfway from the value before, as a cut at a common value would part the low ends of all its points from the high ones
    before = drawn[np.maximum(np.searchsorted(drawn, cuts) - 1, 0)] if len(cuts) else cuts
    cuts = np.where(before < cuts, before + (cuts - before + 1) // 2, cuts)
    base = np.append(0, np.cumsum(copies))
    to = lambda v: np.searchsorted(cuts, v, "right")
    # rows counted: those up to the high end less those up to the low end
    low, high = lambda at, r: np.where(r == 0, at - 1, at - r), lambda at, r: np.where(r == 0, at, at + r - 1)
    ask, top, bottom, value = 0, 1, 2, 3  # a point that is settled in its part, its two ends elsewhere, and what only counts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, at, m, r = (b.column(c).to_numpy() for c in ("x", "y", axis, "m", "r"))
            i, here, j = to(low(at, r)), to(at), to(high(at, r))
            mixed = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            part = lambda k: base[k] + ((mixed >> np.uint64(33)).astype(np.int64) % copies[k])
            kinds = ((ask, i == j, i), (top, i != j, j), (bottom, i != j, i), (value, (i != j) & (copies[here] == 1), here))
            rows = [np.flatnonzero(of) for _, of, _ in kinds]
            row, ends = np.concatenate(rows), np.repeat([False, True, True, False], [*map(len, rows)])
            parts = np.concatenate([part(k)[rows[kind]] for kind, _, k in kinds])
            kind = np.repeat(np.arange(4), [*map(len, rows)])
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(kind), pa.array(at[row]), pa.array(r[row]), pa.array(m[row]), pa.array(x[row], mask=~ends), pa.array(y[row], mask=~ends)], names=["part", "kind", "at", "r", "m", "x", "y"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(copies[to(b.column(0).to_numpy())] > 1)
            yield b.filter(keep)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = to(b.column(0).to_numpy())
            row = np.repeat(np.arange(len(k)), copies[k])
            part = base[k[row]] + np.arange(len(row)) - np.repeat(np.cumsum(copies[k]) - copies[k], copies[k])
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=["part", "v", "m"])

    def count(asked: pa.Table, held: pa.Table | None = None) -> pa.Table:
        part = (asked if len(asked) else held)["part"][0].as_py()
        range_ = int(np.searchsorted(base, part, "right")) - 1
        kind, at, r, m = (asked[c].to_numpy() for c in ("kind", "at", "r", "m"))
        if copies[range_] == 1:
            own = (kind == ask) | (kind == value)
            v, weight = at[own], m[own]
        else:
            v, weight = held["v"].to_numpy(), held["m"].to_numpy()
        order = np.argsort(v)
        upto, v = np.append(0, np.cumsum(weight[order])), v[order]
        under = lambda c: upto[np.searchsorted(v, c, "right")]
        here, ends = kind == ask, np.flatnonzero((kind == top) | (kind == bottom))
        total = float((m[here] * psi(under(high(at[here], r[here])) - under(low(at[here], r[here])))).sum())
        up = kind[ends] == top
        some = np.where(up, under(high(at[ends], r[ends])), -under(low(at[ends], r[ends])))
        first = lambda x, rest: pa.concat_arrays([pa.array([x], rest.type), rest])
        none = pa.nulls(len(ends), pa.int64())
        who = {c: first(None, asked[c].combine_chunks().take(pa.array(ends))) for c in ("x", "y", "m")}
        return pa.table({"range": pa.array(np.full(len(ends) + 1, range_)), **who, "n": first(None, pa.array(some)), "sign": first(None, pa.array(np.where(up, 1, -1))), "weight": first(int(upto[-1]) if part == base[range_] else 0, none), "psi": first(total, none.cast(pa.float64()))})

    asked = points.select("x", "y", "m", "r").mapInArrow(deal, "part long, kind long, at long, r long, m long, x long, y long").groupBy("part")
    fields = "range long, x long, y long, m long, n long, sign long, weight long, psi double"
    if (copies > 1).any():
        values = points.select(axis, "m").mapInArrow(common, f"{axis} long, m long").groupBy(axis).agg(F.sum("m").alias("m"))
        held = values.mapInArrow(spread, "part long, v long, m long")
        counted = saved.save(asked.cogroup(held.groupBy("part")).applyInArrow(count, fields))
    else:
        counted = saved.save(asked.applyInArrow(lambda t: count(t), fields))
    weights = {r[0]: r[1] for r in counted.groupBy("range").agg(F.sum("weight")).collect()}  # a row a range
    before = np.append(0, np.cumsum([weights.get(k, 0) for k in range(len(copies))]))
    before = F.element_at(F.lit(before.tolist()), F.col("range").cast("int") + 1)
    split = counted.where("x IS NOT NULL").groupBy("x", "y").agg(F.max("m").alias("m"), F.sum(F.col("n") + F.col("sign") * before).alias("n"))
    out = sum(df.first()[0] or 0.0 for df in (counted.agg(F.sum("psi")), split.agg(F.sum(F.col("m") * digamma(F.col("n"))))))
    saved.drop(counted)
    return out


def neighbour_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3, saved: Saved | None = None) -> DataFrame:
    """(column, n, mi) in nats: psi(n) + psi(k) - mean of psi(a + 1) + psi(b + 1), at least 0, where a and b count the rows whose value of
    the column and of the target lies closer than the k-th neighbour's larger difference. Where k others equal a row in
    both, a and b count the rows equal to it.

    Rows with a null, NaN or infinite value in one of the two are left out for that column. mi is null for at most k rows, and where
    a column or the target is constant.
    """
    own = saved or Saved(df.sparkSession, "information")
    out = []
    for c in columns:
        finite = (F.abs(F.col(c).cast("double")) < float("inf")) & (F.abs(F.col(target).cast("double")) < float("inf"))
        rows = df.where(finite).select(F.col(c).cast("double").alias("x"), F.col(target).cast("double").alias("y"))
        stats = rows.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).first()
        if stats.n <= k or not stats.sx or not stats.sy:
            out.append((c, stats.n, None))
            continue
        on = lambda v, mean, sd: F.round((F.col(v) - F.lit(mean)) / F.lit(sd) * GRID).cast("long").alias(v)
        points = own.save(rows.select(on("x", stats.x, stats.sx), on("y", stats.y, stats.sy)).groupBy("x", "y").agg(F.count("*").alias("m")))
        distinct = points.count()
        radii = _radii(points, distinct, k, own)
        means = [_margin(radii, axis, distinct, own) / stats.n for axis in ("x", "y")]
        out.append((c, stats.n, max(0.0, float(psi(np.array([stats.n, k])).sum()) - sum(means))))
        own.drop(points), own.drop(radii)
    own.drop(own.root)
    return df.sparkSession.createDataFrame(out, "column string, n long, mi double")
