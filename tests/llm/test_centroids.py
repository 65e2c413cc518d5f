"""Operator 13 against whole scans in NumPy, on vectors with structure, ties, copies and odd rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest

from tidecast.llm import centroids, queries


def plain(ids, v, k=40, rounds=5):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), tuple(v[i].tolist())))[:k]
    c = v[order].copy()
    for turn in range(rounds + 1):
        d = np.stack([((v - y) ** 2).sum(1) for y in c], 1)
        a = d.argmin(1)
        if turn < rounds:
            for j in np.unique(a):
                c[j] = v[a == j].sum(0) // (a == j).sum()
    near = d[np.arange(len(v)), a]
    inertia = [int(near[a == j].sum()) for j in range(len(c))]
    shas = [hashlib.sha256(",".join(map(str, y.tolist())).encode()).hexdigest() for y in c]
    return sorted((int(i), int(j), int(x), int(inertia[j]), int(near.sum()), shas[j]) for i, j, x in zip(ids, a, near, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string, upper double")


def mine(df):
    return sorted(tuple(r)[:6] for r in df.collect())


@pytest.mark.parametrize(("seed", "spread", "k"), [(1, 0.02, 40), (2, 1.0, 40), (3, 0.3, 7), (4, 0.0, 12), (5, 0.1, 1)])
def test_clusters_equal_whole_scans(spark, seed, spread, k):
    """Tight groups, no structure, few centroids, only copies (every centroid has twins), and one centroid."""
    rng = np.random.RandomState(seed)
    x = rng.randint(-3, 4, (15, 64))[rng.randint(0, 15, 900)] + np.round(spread * rng.randn(900, 64), 2)
    df = frame(spark, [(i, [float(c) for c in r]) for i, r in enumerate(x)])
    got = centroids.cluster(df, k=k)
    assert mine(got) == plain(np.arange(900), np.floor(256 * x).astype(np.int64), k)
    if spread == 0.02:
        assert got.agg({"looked": "avg"}).first()[0] < 0.25 * k  # few centroids are looked at where there is structure


def test_ties_on_a_small_grid_go_to_the_smaller_number(spark):
    rng = np.random.RandomState(8)
    x = rng.randint(0, 2, (1500, 64)) * (np.arange(64) < 3) / 256
    assert mine(centroids.cluster(frame(spark, [(i, r.tolist()) for i, r in enumerate(x)]), k=20)) == plain(np.arange(1500), np.floor(256 * x).astype(np.int64), 20)


def test_large_values_are_exact(spark):
    rng = np.random.RandomState(9)
    x = rng.randint(-(1 << 23), 1 << 23, (300, 64)).astype(np.int64)
    x[:5, 0] = (1 << 27) - 1
    rows = [(i, (r / 256).tolist()) for i, r in enumerate(x)] + [(999, [2.0**19] + [0.0] * 63)]
    assert mine(centroids.cluster(frame(spark, rows), k=9)) == plain(np.arange(300), x, 9)


def test_rows_that_take_no_part_repeats_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 7] * 64) for k in range(5)] + [(3, [3 / 7] * 64), (3, [-1.0] * 64)]
    odd = [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [nan] + [1.0] * 63), (55, [None] + [1.0] * 63), (56, [1.0] * 63 + [-inf])]
    ids, v = [i for i, _ in good], np.floor(256 * np.array([r for _, r in good])).astype(np.int64)
    assert mine(centroids.cluster(frame(spark, good + odd))) == plain(ids, v)
    assert centroids.cluster(frame(spark, odd)).count() == 0 == centroids.cluster(frame(spark, odd).limit(0)).count()
    assert [r.vec_id for r in centroids.cluster(frame(spark, [(None, [1.0] * 64)])).collect()] == [None]


def test_the_query_over_its_table(spark, data):
    f = pd.read_parquet(f"{data}/embeddings.parquet")
    v = np.floor(256 * np.stack(f.embedding.to_numpy()).astype(float)).astype(np.int64)
    assert mine(queries.op13_centroid_clusters(spark, data)) == plain(f.vec_id.tolist(), v)
