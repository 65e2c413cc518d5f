"""Operator 7: mixing sources to target weights by capped water-filling and seeded repetitions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the sampling hash that one histogram pass resolves.
RADIX_BITS = 12


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size: the number of words in text; null and empty texts have 0."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def water_fill(totals: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources by code point, null last, take the weights in turn and share all words. A source stops at max_epochs times
    its size; what it can't take goes to the others by weight until none is above its cap. Sorted by cap over weight,
    the clamped sources come first, and the water level (target per weight of an unclamped source) is the highest of
    (words left) / (weight left) along that order, so the fixed point needs no loop. One row per source is windowed.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("level", F.try_divide(left, weight_left))
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least("cap", F.col("weight") * F.col("level")))
        .drop("level")
    )


def _hashed(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """docs with its sampling hash and the hash's two histogram digits."""
    bits = F.xxhash64(F.lit(seed), F.col(key), F.lit("mix"))
    return docs.withColumns({"mix_bits": bits, "mix_high": F.shiftrightunsigned(bits, 64 - RADIX_BITS), "mix_low": F.shiftrightunsigned(bits, 64 - 2 * RADIX_BITS).bitwiseAND(2**RADIX_BITS - 1)})


def _place(bits: str, key: str) -> Column:
    return F.struct(F.shiftrightunsigned(bits, 1).alias("b"), F.col(bits).alias("bits"), F.col(key).alias("key"))


def _same(x: str, y: str) -> Column:
    return F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))


def _few(df: DataFrame, name: str) -> DataFrame:
    """A saved table of a row or a few per source: broadcast while it is small, else joined by shuffling."""
    return F.broadcast(df.alias(name)) if df.count() <= 100_000 else df.alias(name)


def bounds(sized: DataFrame, scratch: Scratch, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """(source, source_size, target, whole, wanted, b_high, b_low, b_upto) by source: whole repetitions, and where the
    documents end, in hash order, that are taken once more. sized: a saved (key, source, size, mix_*) table."""
    histogram = scratch.save(sized.groupBy("source", "mix_high").agg(F.sum("size").alias("words")), "high")
    totals = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = water_fill(totals, weights, max_epochs).select("source", "source_size", "target")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = scratch.save(targets, "targets")

    def cut(buckets: DataFrame, by: str) -> DataFrame:
        """The bucket of each source in which the running sum of words passes the wanted ones, and the sum before it."""
        run = Window.partitionBy("source").orderBy(by)
        passed = buckets.withColumn("upto", F.sum("words").over(run)).where(F.col("upto") > F.col("wanted"))
        return passed.groupBy("source").agg(F.min(F.struct(by, (F.col("upto") - F.col("words")).alias("before"), "wanted")).alias("c")).select("source", f"c.{by}", "c.before", "c.wanted")

    first = scratch.save(cut(histogram.alias("h").join(targets.alias("t"), _same("h", "t")).select("h.source", "mix_high", "words", "wanted"), "mix_high"), "first")
    inside = sized.alias("s").join(_few(first, "f"), _same("s", "f") & (F.col("s.mix_high") == F.col("f.mix_high")))
    inside = scratch.save(inside.select("s.source", "s.key", "s.size", "s.mix_low", "s.mix_bits", "f.before", "f.wanted"), "inside")
    lows = inside.groupBy("source", "mix_low").agg(F.sum("size").alias("words"), (F.first("wanted") - F.first("before")).alias("wanted"))
    second = scratch.save(cut(lows, "mix_low"), "second")
    last = inside.alias("i").join(_few(second, "c"), _same("i", "c") & (F.col("i.mix_low") == F.col("c.mix_low")))
    last = last.select("i.source", "i.key", "i.mix_bits", "i.size", (F.col("c.wanted") - F.col("c.before")).alias("wanted"))
    # the document that straddles the bound is taken if more than half of it lies below
    end = F.sum("size").over(Window.partitionBy("source").orderBy(_place("mix_bits", "key")).rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("takes", end - F.col("size") / 2 <= F.col("wanted")).where("takes")
    last = last.groupBy("source").agg(F.max(_place("mix_bits", "key")).alias("upto"))
    out = targets.alias("t").join(first.alias("f"), _same("t", "f"), "left").join(second.alias("c"), _same("t", "c"), "left").join(last.alias("l"), _same("t", "l"), "left")
    return scratch.save(out.select("t.*", F.col("f.mix_high").alias("b_high"), F.col("c.mix_low").alias("b_low"), F.col("l.upto").alias("b_upto")), "bounds")


def _repeats(place: Column, max_epochs: int) -> Column:
    below = (F.col("mix_high") < F.col("b_high")) | ((F.col("mix_high") == F.col("b_high")) & ((F.col("mix_low") < F.col("b_low")) | ((F.col("mix_low") == F.col("b_low")) & (place <= F.col("b_upto")))))
    # without a bound the running sum never passes the wanted words: all (wanted = the whole source, or nothing to take)
    extra = F.when(F.col("wanted") <= 0, 0).when(F.col("b_high").isNull(), 1).when(F.coalesce(below, F.lit(False)), 1).otherwise(0)
    return F.least(F.col("whole") + extra, F.lit(max_epochs)).cast("long")


def _sized(docs: DataFrame, scratch: Scratch, seed: int, key: str, text: str, source: str) -> DataFrame:
    sized = measure(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")), "text").drop("text")
    return scratch.save(_hashed(sized, "key", seed), "sized")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, repeats, taken) of every document.

    A source at r times its size repeats every document floor(r) times and, once more, those of its documents whose
    seeded hash lies below a bound. Two histograms of the hash by source (4096 buckets each, so the boundary is known
    to a 2**-24th of the source) and the exact order inside the last bucket place the bound where the words taken come
    nearest to the target. No task holds a source: the histograms are partially aggregated, the last order sees one
    bucket. Nulls: a null source is a source of its own; a null text has size 0 and is repeated with its source.
    Repeated rows count each. An empty table gives an empty result. Reruns agree: the hash depends on seed and key.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = _sized(docs, scratch, seed, key, text, source)
    out = sized.alias("s").join(_few(bounds(sized, scratch, weights, max_epochs), "b"), _same("s", "b"))
    out = out.select("s.*", "b.source_size", "b.target", _repeats(_place("s.mix_bits", "s.key"), max_epochs).alias("repeats"))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as mix() repeats it, its own columns only; the texts aren't shuffled while sources are few."""
    scratch = Scratch(docs.sparkSession, "mix")
    bound = bounds(_sized(docs, scratch, seed, key, text, source), scratch, weights, max_epochs)
    row = _hashed(docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(source).alias("source")), "key", seed)
    out = row.alias("s").join(_few(bound, "b"), _same("s", "b")).select("s.row", _repeats(_place("s.mix_bits", "s.key"), max_epochs).alias("repeats"))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))).alias("again")).select("row.*")
