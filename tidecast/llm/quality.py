"""Operator 9: document quality by ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, chunks, mix

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 17, 1 << 13
#: Shares of a document's words from which a shape counts as present, once more at each step.
STEPS = np.array([1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2])
# Character classes: lower, upper, digit, beyond ASCII, and a class for each other byte.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def _distinct(feature: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (doc, feature) pairs as features and offsets by document, with counts."""
    both = np.unique(doc.astype(np.int64) << 32 | feature.astype(np.int64))
    return both & 0xFFFFFFFF, np.searchsorted(both >> 32, np.arange(docs + 1))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a chunk's documents, and their offsets: present words, and shapes of words by their share.

    A shape is a word's first and last two character classes and whether capitals follow its first letter; "same as the
    word before" and "seen before in the document" are shapes too. Every feature counts once, so length doesn't scale it.
    """
    w, docs = Words(data, off), len(off) - 1
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
    words = w.hash % np.uint64(WORD_BUCKETS)
    capital = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91))])
    inner = np.minimum(capital[w.end] - capital[w.start] - (capital[w.start + 1] - capital[w.start]), 1).astype(np.uint64)
    cls = _CLASS[data]
    last = w.end - 1
    shape = cls[w.start] | cls[last] << np.uint64(8) | cls[np.maximum(last - 1, w.start)] << np.uint64(16) | inner << np.uint64(24)
    order = np.lexsort((w.hash, w.doc))
    again = np.zeros(len(order), bool)
    again[1:] = (w.hash[order[1:]] == w.hash[order[:-1]]) & (w.doc[order[1:]] == w.doc[order[:-1]])
    same = np.zeros(len(order), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    shapes = mix(np.concatenate([shape, np.full(int(again.sum()), 1 << 30, np.uint64), np.full(int(same.sum()), 1 << 31, np.uint64)])) % np.uint64(SHAPE_BUCKETS // 8)
    owner = np.concatenate([w.doc, w.doc[order][again], w.doc[same]])
    both, count = np.unique(owner.astype(np.int64) << 32 | shapes.astype(np.int64), return_counts=True)
    step = np.searchsorted(STEPS, count / w.counts[both >> 32], "right")
    at = np.repeat(np.arange(len(both)), step)
    level = np.arange(len(at)) - np.repeat(np.cumsum(step) - step, step)
    f = np.concatenate([words.astype(np.int64), WORD_BUCKETS + (both[at] & 0xFFFFFFFF) * 8 + level])
    return _distinct(f, np.concatenate([w.doc, both[at] >> 32]), docs)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds: P(grade <= k) = sigmoid(thresholds[k] - score). cut: the least P(top grade) to stay."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k + 1) by threshold; their sum is the expected grade."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sums(weights: np.ndarray, f: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(weights[f])])
    return run[off[1:]] - run[off[:-1]]


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = 8, batch: int = 64, rate: float = 0.1, l2: float = 1e-4, least: int = 4, seed: int = 5) -> Ordinal:
    """Maximum likelihood by AdaGrad over seeded mini-batches; a feature of fewer than `least` documents keeps weight 0."""
    size = WORD_BUCKETS + SHAPE_BUCKETS
    share = np.array([(grades <= k).mean() if len(grades) else 0.5 for k in range(levels - 1)])
    share = np.clip(np.maximum.accumulate(share + 1e-6 * np.arange(levels - 1)), 0.01, 0.99)
    t = np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1)
    weights = np.zeros(size)
    if not len(rows):
        return Ordinal(weights, t)
    top = grades == levels - 1
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, top, strict=True) if g == side] or [np.zeros(0, np.int64)]), minlength=size) for side in (True, False)]
    seen = counts[0] + counts[1] >= least
    # features that tell the top grade from the rest move further at each step, less so if chance could explain the difference
    ratio = np.log((counts[0] + 1) / (top.sum() + 2)) - np.log((counts[1] + 1) / ((~top).sum() + 2))
    scale = np.abs(ratio) * (1 - np.exp(-(ratio**2) / (1 / (counts[0] + 1) + 1 / (counts[1] + 1)) / 4))
    rows = [r[seen[r]] for r in rows]
    square, t_square = np.full(size, 1e-4), np.full(levels - 1, 1e-4)
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            f = np.concatenate([rows[i] for i in pick])
            off = np.concatenate([[0], np.cumsum([len(rows[i]) for i in pick])])
            s, y = _sums(weights * scale, f, off), grades[pick]
            edge = np.concatenate([np.full((len(pick), 1), 0.0), _sigmoid(t[None, :] - s[:, None]), np.full((len(pick), 1), 1.0)], 1)
            row = np.arange(len(pick))
            upper, lower = edge[row, y + 1], edge[row, y]
            p = np.maximum(upper - lower, 1e-9)
            ds = (1 - upper - lower) / len(pick)
            dt = np.zeros(levels - 1)
            np.add.at(dt, np.minimum(y, levels - 2), np.where(y < levels - 1, -upper * (1 - upper) / p, 0.0) / len(pick))
            np.add.at(dt, np.maximum(y - 1, 0), np.where(y > 0, lower * (1 - lower) / p, 0.0) / len(pick))
            touched = np.unique(f)
            g = np.bincount(np.searchsorted(touched, f), np.repeat(ds, np.diff(off)), len(touched)) * scale[touched] + l2 * weights[touched]
            square[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(square[touched])
            t_square += dt * dt
            t = t - rate * dt / np.sqrt(t_square)
            t = np.maximum.accumulate(t + 1e-3 * np.arange(levels - 1)) - 1e-3 * np.arange(levels - 1) if levels > 2 else t
    return Ordinal(weights * scale, t)


def choose_cut(rows: list[np.ndarray], grades: np.ndarray, levels: int, lose: float = 0.005, seed: int = 7) -> float:
    """The highest P(top grade) that loses at most the share `lose` of top-grade documents held out of a fit, a fifth of all.

    One half at least, and one half if fewer than 50 of them are held out.
    """
    held = np.random.RandomState(seed).permutation(len(rows)) < len(rows) // 5
    top = np.flatnonzero(held & (grades == levels - 1))
    if len(top) < 50:
        return 0.5
    model = fit([rows[i] for i in np.flatnonzero(~held)], grades[~held], levels)
    score = _sums(model.weights, np.concatenate([rows[i] for i in top]), np.concatenate([[0], np.cumsum([len(rows[i]) for i in top])]))
    return max(0.5, float(np.sort(model.tails(score)[:, -1])[int(lose * len(top))]))


def train(docs: DataFrame, ratings: DataFrame, levels: int, sample: int = 24000, key: str = "doc_id", text: str = "text", grade: str = "grade", seed: int = 3) -> Ordinal:
    """A model and its cut from the documents of ratings (key, grade 0..levels-1; null grades and keys are left out).

    At most `sample` ratings, those of lowest seeded hash, are used: the bound of what reaches the driver, where the
    fit runs (about 400 feature numbers a document). A key rated twice counts twice; of a key that docs hold more than
    once, the smallest text counts, so repeats in docs don't pass the bound.
    """
    picked = ratings.where(F.col(grade).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(grade).cast("int").alias("grade"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
    picked = picked.orderBy("h", "grade").limit(sample).select("key", "grade")
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked.select("key").distinct()), "key", "left_semi")
    if held.groupBy("key").count().where("count > 1").limit(1).count():  # else no text needs to move
        held = held.groupBy("key").agg(F.min("text").alias("text"))
    rows = held.join(F.broadcast(picked), "key").select("key", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(2)):
                f, at = features(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f.astype(np.int32)))], names=["key", "grade", "f"])

    kind = docs.schema[key].dataType.simpleString()
    got = rows.mapInArrow(run, f"key {kind}, grade int, f array<int>").toArrow()
    order = np.lexsort((got["grade"].to_numpy(), got["key"].to_numpy()))  # the same rows in the same order at every run
    lists = [x for c in got["f"].chunks for x in np.split(c.flatten().to_numpy(), (c.offsets.to_numpy()[1:-1] - c.offsets[0].as_py()))[: len(c)]]
    found, grades = [lists[i] for i in order], got["grade"].to_numpy()[order].astype(np.int64)
    model = fit(found, grades, levels)
    model.cut = choose_cut(found, grades, levels)
    return model


def grade(docs: DataFrame, model: Ordinal, least: int, probability: float | None = None, key: str = "doc_id", text: str = "text", keep_columns: bool = False) -> DataFrame:
    """key, expected_grade, p_ge_1 .. p_ge_<levels-1>, kept (P(grade >= least) >= probability) of every row; no shuffle.

    Without a probability it is the model's cut for the top grade and one half for others. With keep_columns, docs' own
    columns in place of the key, but those whose names clash with a result's: the result takes the name. Null and empty
    texts have no features and are graded by the thresholds alone. Whole texts; repeated rows count each; an empty table
    gives an empty result.
    """
    tails = len(model.thresholds)
    if probability is None:
        probability = model.cut if least == tails else 0.5
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    names = ["expected_grade", *(f"p_ge_{k + 1}" for k in range(tails)), "kept"]
    source = docs.select([c for c in docs.columns if c not in names or c == text] if keep_columns else [key, text])
    at, width = source.columns.index(text), len(source.columns) if keep_columns else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shipped.value)
        for batch in batches:
            for i, j, data, off in chunks(batch.column(at)):
                p = own.tails(_sums(own.weights, *features(data, off)))
                part = [c.slice(i, j - i) for c in batch.columns[:width]]
                yield pa.RecordBatch.from_arrays([*part, pa.array(p.sum(1)), *(pa.array(p[:, k]) for k in range(tails)), pa.array(p[:, least - 1] >= probability)], names=[*batch.schema.names[:width], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:width]), *(f"{n} double" for n in names[:-1]), "kept boolean"])
    return source.mapInArrow(run, schema)
