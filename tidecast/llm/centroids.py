"""Operator 13: exact centroid clustering of vectors on an integer grid, by exponion search.

Every vector keeps an upper bound on the distance to its own centroid and a lower bound on that to any other. After the
centroids have moved, both are loosened by the moves. A vector whose upper bound is below its lower bound, or below half
the distance from its centroid to the next one, stays. The others take their exact distance u; whatever is at least as
near, and the second nearest too, lies in a ball of radius 2u + (distance to the next centroid) around the own centroid,
a prefix of that centroid's sorted list of neighbours. The ball is closed and the tests are strict, so ties go to the
smaller number as in a whole scan. Squared distances are whole numbers; only bounds are rounded, outwards.

One round is a narrow pass that writes vectors and bounds anew, and sums by cluster: cluster rows a task, then k rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Grid values stay below this in magnitude, so that squared distances of 64 components fit 62 bits.
LIMIT = 1 << 27
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9


def _packed(v: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binary values of 4 bytes a component."""
    data = np.ascontiguousarray(v, "<i4")
    at = np.arange(len(v) + 1, dtype=np.int32) * np.int32(4 * v.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    _, offsets, data = column.cast(pa.binary()).buffers()
    if not len(column):
        return np.zeros((0, dims), np.int64)
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, "<i4", len(column) * dims, first).reshape(-1, dims).astype(np.int64)


def on_grid(vectors: DataFrame, key: str, column: str, dims: int, scale: int) -> DataFrame:
    """(id, v) of the vectors with exactly `dims` components, all finite: v holds floor(scale * component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            ids, rows = batch.column(0).filter(fits), lists.filter(fits)
            x = pc.fill_null(rows.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                grid = np.floor(scale * x)
                keep = (np.abs(grid) < LIMIT).all(1)  # false for NaN and infinities
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), _packed(grid[keep].astype(np.int64))], names=["id", "v"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("id"), column).mapInArrow(run, f"id {kind}, v binary")


class Centroids:
    """Centroids with each one's sorted list of the others, itself first."""

    def __init__(self, c: np.ndarray):
        self.c, self.k = c, len(c)
        between = np.sqrt(np.stack([((c - x) ** 2).sum(1) for x in c]).astype(float))
        between[np.arange(self.k), np.arange(self.k)] = -1.0  # first, before copies of itself
        self.order = np.argsort(between, axis=1, kind="stable")
        self.gap = np.take_along_axis(between, self.order, 1)
        self.gap[:, 0] = 0.0
        self.next = self.gap[:, 1] if self.k > 1 else np.full(1, np.inf)
        self.most = int(np.abs(c).max(initial=0))

    def squared(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of all rows of v to the chosen centroids."""
        c, most = self.c[which], max(self.most, int(np.abs(v).max(initial=0)))
        if 4 * v.shape[1] * most * most < 1 << 53:  # every term is a whole number that a double holds
            x, y = v.astype(float), c.astype(float)
            return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
        return np.stack([((v - y) ** 2).sum(1) for y in c], 1)

    def own(self, v: np.ndarray, a: np.ndarray) -> np.ndarray:
        return ((v - self.c[a]) ** 2).sum(1)

    def assign(self, v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Updates clusters and bounds in place; how many centroids each row was compared with."""
        looked = np.zeros(len(v), np.int32)
        if self.k == 1:
            a[:], upper[:], lower[:] = 0, np.inf, np.inf
            return looked
        settled = lambda i: upper[i] < np.maximum(lower[i], self.next[a[i]] * (0.5 * _DOWN))
        open_ = np.flatnonzero(~settled(slice(None)))
        upper[open_] = np.sqrt(self.own(v[open_], a[open_]).astype(float)) * _UP
        looked[open_] += 1
        open_ = open_[~settled(open_)]
        reach = (2 * upper[open_] + self.next[a[open_]]) * _UP
        for own in np.unique(a[open_]):
            rows, r = open_[a[open_] == own], reach[a[open_] == own]
            wide = np.searchsorted(self.gap[own] * _DOWN, r, "right")
            steps = np.minimum(self.k, 1 << np.ceil(np.log2(np.maximum(wide, 2))).astype(int))  # prefixes of 2, 4, 8 ...
            for size in np.unique(steps):
                i, which = rows[steps == size], np.sort(self.order[own][:size])
                d = self.squared(v[i], which)
                best = d.argmin(1)  # the first of equal ones, and `which` ascends
                near = d[np.arange(len(i)), best]
                d[np.arange(len(i)), best] = np.iinfo(np.int64).max
                a[i], upper[i], lower[i] = which[best], np.sqrt(near.astype(float)) * _UP, np.sqrt(d.min(1).astype(float)) * _DOWN
                looked[i] += size
        return looked


def _passed(state: DataFrame, c: np.ndarray, moved: np.ndarray | None, dims: int) -> DataFrame:
    """One round's pass: bounds loosened by how far each centroid moved, then every vector's cluster, bounds and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Centroids(c)
        for batch in batches:
            v, n = _unpacked(batch.column(1), dims), batch.num_rows
            if moved is None:
                a, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
            else:
                a, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4))
                others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(len(moved))])
                upper, lower = (upper + moved[a]) * _UP, (lower - others[a]) * np.where(lower > others[a], _DOWN, _UP)
            looked = space.assign(v, a, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a), pa.array(upper), pa.array(lower), pa.array(space.own(v, a)), pa.array(looked)], names=["id", "v", "cluster", "upper", "lower", "distance", "looked"])

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(run, f"id {kind}, v binary, cluster int, upper double, lower double, distance long, looked int")


def _means(state: DataFrame, k: int, dims: int) -> dict[int, list[int]]:
    """floor(sum / count) of each non-empty cluster: every task adds up its own vectors, k rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            a, v = batch.column(0).to_numpy(), _unpacked(batch.column(1), dims)
            n += np.bincount(a, minlength=k)
            order = np.argsort(a, kind="stable")
            own, at = np.unique(a[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(v[order], at, axis=0)
        full = np.flatnonzero(n)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * np.int32(dims)), pa.array(sums[full].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), values], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]).collect()
    return {r.cluster: [int(r[f"s{i}"]) // r.n for i in range(dims)] for r in rows}


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", key: str = "vec_id", column: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256, looked) of every vector that takes part.

    Vectors with exactly `dims` components, none null, NaN or infinite, take part, as floor(scale * component). Those with
    a grid value of 2**27 or more in magnitude don't: their squared distances don't fit a long. The first centroids are
    the k vectors of smallest sha256(seed:key), in that order; rows that repeat a key stand in the order of their values,
    null keys come last, and with fewer than k vectors there are as many centroids as vectors. Every round moves each
    non-empty centroid to floor(mean) of its vectors; then vectors are assigned once more. Ties go to the smaller number;
    equal centroids are allowed, so the later ones stay empty. Rows that repeat count each. No vector at all gives no
    rows; other columns are ignored. looked: centroids that the last pass compared the vector with.

    The driver holds k centroids. Vectors and bounds are saved once a round in a new folder of scratch.
    """
    own = scratch or Scratch(vectors.sparkSession, "centroids")
    grid = on_grid(vectors, key, column, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = grid.select("id", "v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    kind = vectors.schema[key].dataType.simpleString()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, looked int")
    c = np.stack([np.frombuffer(bytes(r.v), "<i4") for r in first]).astype(np.int64)
    state, moved = own.save(_passed(grid, c, None, dims), "round"), None
    for _ in range(rounds):
        new = c.copy()
        for j, mean in _means(state, len(c), dims).items():
            new[j] = mean
        moved = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * _UP
        c = new
        after = own.save(_passed(state, c, moved, dims), "round")
        own.drop(state)
        state = after
    sums = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    longs = lambda xs: F.array(*[F.lit(x if x < 1 << 63 else None).cast("long") for x in xs])
    named = F.array(*[F.lit(hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for x in c])
    of = lambda a: F.element_at(a, F.col("cluster") + 1)
    return state.select(F.col("id").alias(key), "cluster", "distance", of(longs([sums.get(j, 0) for j in range(len(c))])).alias("cluster_inertia"), longs([sum(sums.values())])[0].alias("inertia"), of(named).alias("centroid_sha256"), "looked")
