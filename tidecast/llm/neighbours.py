"""Operator 5: exact embedding near-duplicates by a subspace pigeonhole join. Operator 8: nearest neighbours by vantage-point trees."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, with_ids

#: Rows of a tile's side; larger cells are joined tile by tile, so a task holds two sides at most.
TILE = 2000


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable vectors, their matrix in double precision): not null, not zero, all components finite, one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    off = column.offsets.to_numpy()
    length = np.diff(off)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (length > 0)
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros((0, 0))
    dim = int(np.bincount(length[valid]).argmax())
    rows = np.flatnonzero(valid & (length == dim))
    x = values[off[rows][:, None] + np.arange(dim)[None, :]]
    good = np.isfinite(x).all(1) & (np.abs(x) > 0).any(1)
    assert n >= len(rows)
    return rows[good], x[good]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null, empty or zero and has finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


# --- operator 5 ----------------------------------------------------------------------------------------------------


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(seed).randn(dim, dim))
    return q * np.sign(np.diag(r))


def rotate(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Unit rows of x, rotated; summed in one order, so that a vector has the same bits in every task."""
    norm = np.zeros(len(x))
    for k in range(x.shape[1]):
        norm += x[:, k] * x[:, k]
    x = x / np.sqrt(norm)[:, None]
    out = np.zeros_like(x)
    for k in range(x.shape[1]):
        out += x[:, k, None] * q[None, k, :]
    return out


class Blocks:
    """The pigeonhole: unit vectors at cosine >= c lie within d2 = 2 - 2c, so within d2 * width / dim in some block."""

    def __init__(self, dim: int, cosine: float, blocks: int):
        self.edges = [round(k * dim / blocks) for k in range(blocks + 1)]
        d2 = max(0.0, 2 - 2 * cosine)
        self.budget = np.array([d2 * (b - a) / dim for a, b in zip(self.edges, self.edges[1:])]) * (1 + 1e-9) + 1e-12
        self.reach = np.sqrt(self.budget) * (1 + 1e-9) + 1e-9  # farther than any pair within budget can lie on an axis

    def distances(self, d: np.ndarray) -> np.ndarray:
        """Squared length of difference vectors by block."""
        return np.stack([(d[:, a:b] ** 2).sum(1) for a, b in zip(self.edges, self.edges[1:])], 1)

    def cells(self, y: np.ndarray, block: int, axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is home) of the cells, two reaches wide on the block's first axes, that hold a vector or a point in its reach."""
        r, first = self.reach[block], self.edges[block]
        half = math.ceil(1 / (2 * r)) + 2
        bits = (2 * half).bit_length()
        part = y[:, first : first + min(axes, self.edges[block + 1] - first, 62 // bits)]
        home = np.floor(part / (2 * r)).astype(np.int64)
        side = np.where(part - home * 2 * r < r, -1, 1)  # the one neighbour on each axis that may be in reach
        gap = np.where(side < 0, part - home * 2 * r, (home + 1) * 2 * r - part)
        rows, cells, own = [], [], []
        for mask in range(1 << part.shape[1]):
            pick = np.array([(mask >> k) & 1 for k in range(part.shape[1])], bool)
            near = (gap[:, pick] ** 2).sum(1) <= r * r * (1 + 1e-6)
            c = np.where(pick[None, :], home + side, home)[near] + half
            code = np.zeros(len(c), np.int64)
            for k in range(c.shape[1]):
                code = code << bits | c[:, k]
            rows.append(np.flatnonzero(near))
            cells.append(code)
            own.append(np.full(len(c), mask == 0))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(own)


def within(h: np.ndarray, o: np.ndarray, a: np.ndarray, b: np.ndarray, budget: float, strip: int = 32) -> tuple[np.ndarray, np.ndarray, int]:
    """Which rows of h and of o have a partner of the other side within the squared distance, with a < b; and how many pairs were
    looked at. Both sides are sorted along the first axis, and a strip of h only meets the o in its reach there."""
    hit_h, hit_o, looked = np.zeros(len(h), bool), np.zeros(len(o), bool), 0
    reach = math.sqrt(budget)
    in_h, in_o = np.argsort(h[:, 0], kind="stable"), np.argsort(o[:, 0], kind="stable")
    along, ho, oo = o[in_o, 0], (h * h).sum(1), (o * o).sum(1)
    for s in range(0, len(h), strip):
        i = in_h[s : s + strip]
        lo, hi = np.searchsorted(along, [h[i[0], 0] - reach, h[i[-1], 0] + reach])
        j = in_o[lo:hi]
        near = (ho[i][:, None] + oo[j][None, :] - 2 * (h[i] @ o[j].T) <= budget) & (a[i][:, None] < b[j][None, :])
        hit_h[i] |= near.any(1)
        hit_o[j] |= near.any(0)
        looked += len(i) * len(j)
    return hit_h, hit_o, looked


def _dim(df: DataFrame, vector: str) -> int:
    row = df.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 1


def near_vectors(vectors: DataFrame, cosine: float = 0.98, blocks: int = 8, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """key, n_links, component_id, kept of every row: vectors of one label link at cosine >= `cosine`, in double precision.

    Vectors are rotated and cut into blocks. First only ids and a block's coordinates are range-joined, under the block's
    share of the squared-distance budget: by label, and in larger labels by a grid over as many of the block's axes as
    bring a cell to about `tile` rows. Vectors without a partner in any block end there. The others meet once more, in the
    same cells, with whole vectors: every candidate is verified exactly, and a pair counts in the first block that admits
    it, in its smaller id's cell, so exactly once. Null labels, and vectors that are null, zero, hold null or non-finite
    components (or another length than most) link with nothing. Equal vectors of a label are one class, joined once.
    Links are summed and connected inside a tile, so neither copies nor dense groups make a row for each pair. Rows that
    repeat a key are separate vectors whose links count for each row; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = scratch.save(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")), "rows")
    good = usable(rows, "v").where("label IS NOT NULL AND id IS NOT NULL")
    dim = _dim(good, "v")
    classes = good.where(F.size("v") == dim).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    repeated = bool(good.groupBy("id").count().where("count > 1").limit(1).count())
    name = F.concat_ws(":", "rep", F.col("label").cast("string"), F.sha2(F.to_json("v"), 256)) if repeated else F.col("rep")
    classes = scratch.save(classes.withColumn("name", name), "classes")
    plan, q = Blocks(dim, cosine, min(blocks, dim)), rotation(dim)
    axes = classes.groupBy("label").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / tile))).cast("int").alias("axes"))
    axes = scratch.save(axes, "axes")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column(2))
            if not len(at):
                continue
            y, grid = rotate(x, q), batch.column(3).to_numpy()[at]
            for g in np.unique(grid):
                mine = np.flatnonzero(grid == g)
                for b, (lo, hi) in enumerate(zip(plan.edges, plan.edges[1:])):
                    row, cell, home = plan.cells(y[mine], b, int(g))
                    row = mine[row]
                    take, part = pa.array(at[row]), y[row, lo:hi].astype(np.float32)
                    coords = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * (hi - lo)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.full(len(row), b, np.int32)), pa.array(cell), pa.array(home), batch.column(1).take(take), coords], names=["label", "block", "cell", "home", "name", "y"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    where, tiled = ["label", "block", "cell"], ["label", "block", "cell", "i", "j"]
    placed = with_ids(classes.select("label", "name", "v"), axes, "label", "inner").select("label", "name", "v", "axes").mapInArrow(place, f"label {kinds['label']}, block int, cell long, home boolean, name {kinds['name']}, y array<float>")
    placed = scratch.save(placed, "placed")
    # cells without a home vector, or with one vector, join nothing; large ones are cut into tiles of both sides
    cells = placed.groupBy(*where).agg(F.count("*").alias("k"), F.sum(F.col("home").cast("long")).alias("homes")).where("homes > 0 AND k > 1")
    cells = scratch.save(cells.select(*where, F.ceil(F.col("k") / tile).cast("int").alias("parts")), "cells")
    part = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    first = F.transform(every, lambda p: F.struct(part.alias("i"), p.alias("j"), F.lit(1).alias("side")))
    second = F.transform(every, lambda p: F.struct(p.alias("i"), part.alias("j"), F.lit(2).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("home"), 3).otherwise(2).alias("side")))
    sides = F.when(F.col("parts") == 1, alone).when(F.col("home"), F.concat(first, second)).otherwise(second)
    dealt = placed.join(cells, where).select(*where, F.explode(sides).alias("t"), "name", "y").select(*where, "t.*", "name", "y")

    def candidates(table: pa.Table) -> pa.Table:
        side, name = table["side"].to_numpy(), table["name"].to_numpy()
        h, o = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        hit = np.zeros(len(side), np.int32)
        if len(h) and len(o):
            y = table["y"].combine_chunks()
            y = y.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(side), -1)
            block = table["block"][0].as_py()
            in_h, in_o, _ = within(y[h], y[o], name[h], name[o], plan.budget[block] + 1e-5)  # coordinates are in single precision here
            hit[h[in_h]] |= 1
            hit[o[in_o]] |= 2
        keep = np.flatnonzero(hit)
        return table.select([*tiled, "name"]).take(pa.array(keep)).append_column("side", pa.array(hit[keep]))

    kept = dealt.groupBy(*tiled).applyInArrow(candidates, f"label {kinds['label']}, block int, cell long, i int, j int, name {kinds['name']}, side int")
    kept = scratch.save(kept, "candidates")
    scratch.drop(placed)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        h, o = pdf[(pdf.side & 1) > 0], pdf[(pdf.side & 2) > 0]
        if not len(h) or not len(o):
            return pd.DataFrame({"name": [], "links": [], "root": []})
        block = int(pdf.block.iloc[0])
        x, y = (np.stack([np.asarray(v, np.float64) for v in side.v]) for side in (h, o))
        a, b = h.name.to_numpy(), o.name.to_numpy()
        length = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        i, j = np.nonzero((x @ y.T >= (cosine - 1e-9) * length) & (a[:, None] < b[None, :]))
        rx, ry = rotate(x, q), rotate(y, q)
        keep = [np.zeros(0, np.int64)]
        for s in range(0, len(i), 100_000):  # exact cosine, and the first block within budget
            p, r = i[s : s + 100_000], j[s : s + 100_000]
            first = (plan.distances(rx[p] - ry[r]) <= plan.budget).argmax(1) == block
            u, v = x[p[first]], y[r[first]]
            exact = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) >= cosine
            keep.append(s + np.flatnonzero(first)[exact])
        at = np.concatenate(keep)
        i, j = i[at], j[at]
        ids, place = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
        left, right = place[: len(i)], place[len(i) :]
        links = np.bincount(left, o.copies.to_numpy()[j], len(ids)) + np.bincount(right, h.copies.to_numpy()[i], len(ids))
        root = np.arange(len(ids))
        while True:  # smallest id connected inside the tile
            new = root.copy()
            np.minimum.at(new, left, root[right])
            np.minimum.at(new, right, root[left])
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"name": ids, "links": links.astype(np.int64), "root": ids[root]})

    whole = kept.join(classes.select("name", "copies", "v"), "name")
    tiles = scratch.save(whole.groupBy(*tiled).applyInPandas(join, f"name {kinds['name']}, links long, root {kinds['name']}"), "tiles")
    scratch.drop(kept), scratch.drop(cells), scratch.drop(axes)
    counts = tiles.groupBy("name").agg(F.sum("links").alias("links"))
    comps = components(scratch, tiles, "name", "root").withColumnRenamed("id", "name")
    told = classes.join(counts, "name", "left").join(comps, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    if repeated:
        told = told.join(told.groupBy("comp").agg(F.min("rep").alias("least")), "comp").withColumn("comp", F.col("least"))
    told = told.where("copies > 1 OR links IS NOT NULL OR comp <> rep")
    told = scratch.save(told.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "comp"), "told")
    scratch.keep(rows, told)
    out = rows.join(told, ["label", "v"], "left").select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))


# --- operator 8 ----------------------------------------------------------------------------------------------------


def _distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(1))


def _vantage(y: np.ndarray, rows: np.ndarray, rng: np.random.RandomState) -> int:
    """Of a few rows the one from which the distances to a few others spread most."""
    tries, seen = rng.choice(rows, min(5, len(rows)), False), rng.choice(rows, min(64, len(rows)), False)
    return tries[np.argmax([_distance(y[seen], y[t]).std() for t in tries])]


class Regions:
    """The top of the tree, over a sample: `depth` levels of vantage points and median radii, whose leaves are the shards."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 31):
        rng = np.random.RandomState(seed)
        self.depth, self.points, self.radii = depth, np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)
        parts = {1: np.arange(len(sample))}  # node n has children 2n (near) and 2n + 1 (far)
        for node in range(1, 1 << depth):
            rows = parts.pop(node)
            if len(rows):
                self.points[node] = sample[_vantage(sample, rows, rng)]
                d = _distance(sample[rows], self.points[node])
                self.radii[node] = np.median(d)
                rows = rows[d <= self.radii[node]], rows[d > self.radii[node]]
            parts[2 * node], parts[2 * node + 1] = rows if isinstance(rows, tuple) else (rows, rows)

    def of(self, y: np.ndarray) -> np.ndarray:
        """The shard of each row."""
        node = np.ones(len(y), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.sqrt(((y - self.points[node]) ** 2).sum(1)) > self.radii[node])
        return node - (1 << self.depth)

    def near(self, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every shard that the triangle inequality can't put beyond the row's reach."""
        row, node = np.arange(len(y)), np.ones(len(y), np.int64)
        for _ in range(self.depth):
            gap = np.sqrt(((y[row] - self.points[node]) ** 2).sum(1)) - self.radii[node]
            left, right = gap <= reach[row], -gap <= reach[row]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node - (1 << self.depth)


class Tree:
    """A vantage-point tree over a shard. Rows are kept leaf by leaf; a node has a vantage point and, of either side, the least and
    largest distance from it and the largest norm. Sides are nodes, or leaves as (first, end) of their rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int, seed: int = 23):
        rng, order = np.random.RandomState(seed), []
        norms, at = np.sqrt((x * x).sum(1)), 0
        self.points, self.spans, self.sides = [], [], []
        todo = [(np.arange(len(x)), None)]
        while todo:
            rows, place = todo.pop()
            if len(rows) <= leaf:
                own = (-at - 1, at + len(rows))
                order.append(rows)
                at += len(rows)
            else:
                vp = _vantage(x, rows, rng)
                d = _distance(x[rows], x[vp])
                by = np.argsort(d, kind="stable")
                sides = by[: len(rows) // 2], by[len(rows) // 2 :]
                own = (len(self.points), 0)
                self.points.append(x[vp])
                self.spans.append([(d[i[0]], d[i[-1]], norms[rows[i]].max()) for i in sides])
                self.sides.append([None, None])
                todo += [(rows[sides[k]], (own[0], k)) for k in (1, 0)]
            if place is None:
                self.root = own
            else:
                self.sides[place[0]][place[1]] = own
        order = np.concatenate(order)
        self.ids, self.x = ids[order], x[order]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, points=np.array(self.points), spans=np.array(self.spans), sides=np.array(self.sides, np.int64), root=np.array(self.root))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree, held = cls.__new__(cls), np.load(io.BytesIO(data))
        for name in held.files:
            setattr(tree, name, held[name])
        return tree

    def search(self, qids: np.ndarray, qx: np.ndarray, floor: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query id, id, score) of at most k best rows of each query by inner product, its own row excepted, and how many pairs were
        scored. floor: a score that k rows elsewhere reach, or -inf. A side is skipped when the triangle inequality puts it beyond factor
        times what reach() allows for the k-th best score so far: one is exact, less skips more."""
        q2, least, scored = (qx * qx).sum(1), floor.copy(), 0
        best_score, best_id = np.full((len(qx), k), -np.inf), np.full((len(qx), k), np.iinfo(np.int64).max)
        stack = [(tuple(self.root), np.arange(len(qx)), np.zeros(len(qx)), np.inf)]
        while stack:
            (node, end), q, bound, norm = stack.pop()
            live = bound <= factor * reach(q2[q], norm, least[q]) + 1e-9
            q, bound = q[live], bound[live]
            if not len(q):
                continue
            if node >= 0:
                d = _distance(qx[q], self.points[node])
                bounds = [np.maximum(bound, np.maximum(lo - d, d - hi)) for lo, hi, _ in self.spans[node]]
                first = bounds[0] <= bounds[1]  # each query looks into its nearer side first
                for side, mask in ((1, first), (0, ~first), (0, first), (1, ~first)):
                    if mask.any():
                        stack.append((tuple(self.sides[node][side]), q[mask], bounds[side][mask], self.spans[node][side][2]))
                continue
            rows = slice(-node - 1, end)
            scored += len(q) * (end + node + 1)
            approx = qx[q] @ self.x[rows].T
            edge = np.where(np.isfinite(least[q]), least[q] - 1e-9 * (1 + np.abs(least[q])), -np.inf)  # the product's rounding is finer
            a, b = np.nonzero((approx >= edge[:, None]) & (qids[q][:, None] != self.ids[rows][None, :]))
            if not len(a):
                continue
            touched, group = np.unique(a, return_inverse=True)
            own, at = q[touched], b + rows.start
            s = np.concatenate([best_score[own].ravel(), exact_scores(qx[q[a]], self.x[at])])
            i = np.concatenate([best_id[own].ravel(), self.ids[at]])
            g = np.concatenate([np.repeat(np.arange(len(own)), k), group])
            order = np.lexsort((i, -s, g))
            g = g[order]
            rank = np.arange(len(g)) - np.searchsorted(g, g)
            top = rank < k
            best_score[own[g[top]], rank[top]] = s[order][top]
            best_id[own[g[top]], rank[top]] = i[order][top]
            least[own] = np.maximum(least[own], best_score[own, -1])
        r, c = np.nonzero(np.isfinite(best_score))
        return qids[r], best_id[r, c], best_score[r, c], scored


def reach(q2: np.ndarray, norm: float, least: np.ndarray) -> np.ndarray:
    """How far from a query a row of at most this norm can be if their inner product is to be `least`: 2 q.x = |q|^2 + |x|^2 - |q - x|^2."""
    return np.where(np.isfinite(least), np.sqrt(np.maximum((q2 + norm * norm) * (1 + 1e-12) - 2 * np.where(np.isfinite(least), least, 0), 0)), np.inf)


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in one order, so that equal vectors tie exactly."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 0.18, shard_rows: int = 8192, query_rows: int = 16384, leaf: int = 64, sample: int = 20_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: each query's k nearest rows of vectors by inner product, nearest first, ties to the smaller key.

    The top levels of a vantage-point tree, fitted on about `sample` rows, deal every row to a shard; a shard of over
    `shard_rows` rows is cut by hash. Each part's tree is built once and saved. A query searches its own shard first,
    which gives its radius (see reach); then the other shards that the triangle inequality doesn't put beyond factor times
    that radius (one: exact), in blocks of about `query_rows` queries. Only k rows a query and part leave a task. Every row is indexed;
    a query's own key is no candidate; vectors that are null, zero, or hold null or non-finite components (or another
    length than most) take no part. Fewer candidates than k: all of them. Rows that repeat a key are separate candidates
    of the same key; as queries they are one, of the smallest vector. Empty tables give an empty result. Integer keys.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    pick = lambda df: usable(df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")), "v").where("id IS NOT NULL")
    rows = pick(vectors)
    dim = _dim(rows, "v")
    rows, asked = rows.where(F.size("v") == dim), pick(queries).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    n, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    norm, depth = (norm or 1.0) * (1 + 1e-12), max(0, math.ceil(math.log2(max(1, n / shard_rows))))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(1_000_000 * sample / max(1, n))).limit(2 * sample)
    drawn = np.array([r.v for r in drawn.select("v").collect()]).reshape(-1, dim) if depth else np.zeros((0, dim))
    regions = Regions(drawn, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(regions.of(x))], names=["id", "v", "shard"])

    dealt = scratch.save(rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(deal, "id long, v array<double>, shard long"), "dealt")
    asked = scratch.save(asked.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(deal, "id long, v array<double>, shard long"), "asked")
    parts = scratch.save(dealt.groupBy("shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")), "parts")

    def build(table: pa.Table) -> pa.Table:
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.table({"shard": table["shard"][:1], "part": table["part"][:1], "tree": [Tree(table["id"].to_numpy(), x, leaf).dump()]})

    parted = with_ids(dealt, parts, "shard", "inner").select("shard", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int").alias("part"), "id", "v")
    trees = scratch.save(parted.groupBy("shard", "part").applyInArrow(build, "shard long, part int, tree binary"), "trees")
    scratch.drop(dealt)
    blocks = max(1, math.ceil(asked.count() / query_rows))

    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asks) or not len(held):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x = asks["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        q, i, s, _ = Tree.load(held["tree"][0].as_py()).search(asks["id"].to_numpy(), x, asks["floor"].to_numpy(), k, factor)
        return pa.table({"query_id": q, "id": i, "score": s})

    def visit(visits: DataFrame, name: str) -> DataFrame:
        """The best k of each visit (id, v, floor, shard), saved."""
        at = with_ids(visits, parts, "shard", "inner").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        at = at.select("shard", "part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v", "floor")
        held = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        where = ["shard", "part", "block"]
        return scratch.save(at.groupBy(*where).cogroup(held.groupBy(*where)).applyInArrow(run, "query_id long, id long, score double"), name)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = visit(asked.withColumn("floor", F.lit(float("-inf"))), "home")
    if not depth:
        scratch.keep(home)
        return best(home).select("query_id", "rank", F.col("id").alias(key), "score")
    floor = best(home).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = asked.join(floor, "id", "left").select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "shard")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                x, floor, own = part.column(1).flatten().to_numpy().reshape(-1, dim), part.column(2).to_numpy(), part.column(3).to_numpy()
                row, shard = regions.near(x, factor * reach((x * x).sum(1), norm, floor) + 1e-9)
                row, shard = row[shard != own[row]], shard[shard != own[row]]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns[:3]), pa.array(shard)], names=["id", "v", "floor", "shard"])

    rest = visit(known.mapInArrow(others, "id long, v array<double>, floor double, shard long"), "rest")
    scratch.keep(home, rest)
    return best(home.union(rest)).select("query_id", "rank", F.col("id").alias(key), "score")
