"""Operator 11: spelling variants of a corpus' words, grouped under the commonest form, by a rare-first q-gram prefix filter.

One edit destroys at most two of a word's bigrams. So with all bigrams in one global order, rarest first, two words at
distance one share a bigram among the three rarest of each, at places that differ by one at most. That shared bigram is
untouched by the edit, which therefore lies wholly to its left or wholly to its right: the other side is equal in both
words. And of the side with the edit, the first or the last half is equal too. Join keys hold all of that (bigram, its
place from the whole side, a hash of what is equal), so frequent bigrams make no large groups, and what meets is nearly
always a true pair. The exact distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the distinct words of at least `shortest` code points that occur `least` times.

    Words are the lower-cased runs of letters of whole texts; a run whose crc32 of "<key>:<run>" is a multiple of `every` loses
    its code point at crc32 % length. A null key stands as an empty string, null texts have no words.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("key", lowered(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def met(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """a joined with b by a shuffle of both. No side is broadcast by its guessed size: a saved table's is that of packed Parquet, and
    that of keyed words is taken from the words alone, of which each has some twenty keys."""
    return a.join(b.hint("merge"), on, how)


def bigram_order(vocabulary: DataFrame) -> dict[str, int]:
    """Place of each bigram, rarest first, ties by code points. Bigrams of letters are few (at most 90 * 90), whatever the input."""
    grams = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r.gram: i for i, r in enumerate(sorted(found, key=lambda r: (r.n, r.gram)))}


def word_keys(word: str, order: dict[str, int]) -> Iterator[tuple[int, bool]]:
    """(key, longer) of a word: two words at distance one share a key, and at most one of them as the longer."""
    places = sorted(range(len(word) - 1), key=lambda p: (order[word[p : p + 2]], p))[:3]
    for p in places:
        gram, left, right = word[p : p + 2], word[:p], word[p + 2 :]
        for side, whole, part in (("l", left, right), ("r", right, left)):
            # the edit is in `part`, of m code points in the shorter of the two words
            for longer, m in ((False, len(part)), (True, len(part) - 1)):
                if m >= 0:
                    h = m // 2
                    for half, equal in (("a", part[:h]), ("b", part[len(part) - (m - h) :])):
                        yield xxhash.xxh3_64_intdigest(f"{side}{half}{m} {len(whole)} {gram}{whole} {equal}") - (1 << 63), longer


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b), a before b, of all words at distance one; vocabulary: a saved table of distinct words."""
    order = bigram_order(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for i in range(0, len(column), 4096):
                keys, longer, row = [], [], []
                for k, word in enumerate(column.slice(i, 4096).to_pylist()):
                    if len(word) > 1:
                        for key, long_ in dict.fromkeys(word_keys(word, order)):
                            keys.append(key)
                            longer.append(long_)
                            row.append(i + k)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(longer, pa.bool_()), column.take(pa.array(row, pa.int64()))], names=["key", "longer", "word"])

    keyed = vocabulary.select("word").mapInArrow(run, "key long, longer boolean, word string")
    # a word meets its own kind, and the longer words of one more code point; few keys have anybody to meet
    x = keyed.where("NOT longer").select("key", F.col("word").alias("x"))
    y = keyed.select("key", "longer", F.col("word").alias("y"))
    pairs = met(x, y, "key").where((F.col("longer") & (F.length("y") == F.length("x") + 1)) | (~F.col("longer") & (F.length("x") == F.length("y")) & (F.col("x") < F.col("y"))))
    near = pairs.where(F.levenshtein("x", "y", 1) == 1)
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): where the forms lead in the end. Paths double in length each round."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.save(met(now, on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = new
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of words().

    form: the near word (distance one) of largest n, ties to the first in code-point order, if that n is at least `ratio` (2 or
    more) times the word's own; root: where the forms lead, the word itself without one. A null form has a null form_n. Texts
    are read whole; rows that repeat count each; other columns are ignored; an empty table has no words.
    """
    own = scratch or Scratch(docs.sparkSession, "spelling")
    vocabulary = own.save(words(docs, key, text, every, shortest, least), "words")
    pairs = own.save(near_pairs(vocabulary), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    # (-n, word) is smallest for the near word of largest n that comes first
    told = met(both, vocabulary.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    out = met(vocabulary, told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("top.m") >= ratio * F.col("n"), F.col("top")).alias("top"))
    out = own.save(out.select("word", F.col("top.other").alias("form"), "n", "n_near", (-F.col("top.m")).alias("form_n")), "forms")
    ends = roots(out.where("form IS NOT NULL").select("word", "form"), own)
    own.drop(vocabulary), own.drop(pairs)
    return met(out, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
