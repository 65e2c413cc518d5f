"""Operator 10: exact Jaccard metric-space join of shingle sets, with the groups that its links make.

Jaccard distance is a metric, but sets of unrelated texts all lie at distance 1 from each other and from any sampled
pivot: the radius of a link prunes nothing among them, and Voronoi regions of sampled documents would replicate the
whole table. So the table is split in two steps.

1. Seeds. The first pivots are sets of one shingle, at distance 1 from all documents but those that hold it. Two sets at
   distance <= 1 - t share one of the first floor((1-t)n) + 1 shingles of either in any common order, so these are all
   the pivots that a document needs. The order is by hash, but shingles that more than LEAF documents reach ("hot":
   shared passages, groups of copies) come last, so documents that hold some reach down their whole list. A region of
   at most LEAF documents is a leaf: shared seeds of its pairs are counted, pairs that the counts and sizes can't
   exclude are verified on the whole sets.
2. Pivots. Documents of too few other shingles meet in the regions of their rarest hot ones, and these are split by
   pivot documents (`Regions`): exact distances to PIVOTS of them give every document's Voronoi cell, documents within
   the link radius of a pivot are linked to it, and whatever isn't in the largest group of its region then supplies the
   pivots of the next level, more at each level. A pivot meets a document only if no earlier link connects the two, all
   earlier distances of both differ by the radius at most (the triangle inequality), and the hot shingles that both hold
   could make a link, as all others are counted in step 1. A crowded document is its few hot shingles here, for
   distances too; whole sets move only for pairs that can link.

Every step loses no pair at distance <= 1 - t whose documents aren't connected otherwise. Sets are made anew from the
texts where they are needed, as they are larger than the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, components, with_ids
from .words import Words, chunks, lists, shingles

#: Documents that the region of a seed has at most to be a leaf.
LEAF = 8
#: Every document's seeds hold all its shingles up to this one, 30 % of all hashes and a little more than the prefix rule
#: asks for, so that what a document adds later can only meet what others hold beyond it.
BOUND = int(0.3 * (1 << 64))  # of unsigned hashes, as which shingles are sorted
#: Parts of all seeds, by hash, that are grouped one after the other: only one part's shuffle lies on disk, for one more pass
#: over the texts a part.
PARTS = 2
#: Pivots of a region at the first level, and how many times as many each next level has.
PIVOTS, MORE = 4, 16
#: Shingles that the sets of one side of a verification may have together to be broadcast (8 bytes each).
BROADCAST_SHINGLES = 2_000_000
#: Documents with their hot shingles, or regions with those of their pivots, that may be broadcast (a few KB each).
BROADCAST_REGIONS = 2_000


def _shingled(docs: DataFrame, size: int, schema: str, make: Callable) -> DataFrame:
    """docs (id, text, further columns) batch by batch: make(ids and further columns, shingles, offsets) gives the columns of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                s, at = shingles(Words(data, off), size)
                columns = make([c.slice(i, j - i) for k, c in enumerate(batch.columns) if k != 1], s, at)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["id"].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.mapInArrow(run, schema.replace("ID", kind))


def sizes(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, low, key) of (id, text): set size, how many shingles lie up to BOUND, and a 128-bit key of the whole set."""

    def make(columns, s, at):
        keys = [xxhash.xxh3_128_digest(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        low = np.diff(np.concatenate([[0], np.cumsum(s.view(np.uint64) <= np.uint64(BOUND))])[at])
        return [columns[0], pa.array(np.diff(at)), pa.array(low), pa.array(keys, pa.binary())]

    return _shingled(docs, size, "id ID, n long, low long, key binary", make)


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, shingles) of (id, text): sorted distinct shingles."""
    return _shingled(docs, size, "id ID, n long, shingles array<long>", lambda columns, s, at: [columns[0], pa.array(np.diff(at)), lists(s, at)])


def ranges(docs: DataFrame, size: int) -> DataFrame:
    """(id, seed): the shingles from place `lo` up to `hi` of each document's sorted list; docs: (id, text, lo, hi)."""

    def make(columns, s, at):
        lo, hi = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[1:3])
        place = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        take = (place >= lo[row]) & (place < hi[row])
        return [columns[0].take(pa.array(row[take])), pa.array(s[take])]

    return _shingled(docs.select("id", "text", "lo", "hi"), size, "id ID, seed long", make)


def linked(inter: Column, n: Column, m: Column, percent: int) -> Column:
    """percent/100 <= intersection / union, in whole numbers."""
    return 100 * inter >= percent * (n + m - inter)


def in_both(a: Column, b: Column) -> Column:
    """How many distinct values two arrays share."""
    return F.size(F.array_intersect(a, b)).cast("long")


def _least(n: Column, percent: int) -> Column:
    """Shingles of which two linked sets share one, in any common order."""
    return F.floor(n * (100 - percent) / 100) + 1


class Join:
    """One join: the texts of distinct sets (id, text), their sizes (id, n, low), and where its tables are kept."""

    def __init__(self, texts: DataFrame, sizes: DataFrame, scratch: Scratch, percent: int, size: int, leaf: int):
        self.texts, self.sizes, self.scratch, self.percent, self.size, self.leaf = texts, sizes, scratch, percent, size, leaf

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Saved pairs (a, b) and their further columns with n_a, n_b, the exact intersection size inter, and `in`: they link."""
        drop, save = self.scratch.drop, self.scratch.save
        firsts, seconds = (save(pairs.select(F.col(s).alias("id")).distinct(), "ids") for s in "ab")
        whole = save(whole_sets(with_ids(self.texts, firsts.union(seconds), "id"), self.size), "whole")
        left, right = (with_ids(whole, side, "id") for side in (firsts, seconds))  # small id tables meet the sets, which stay where they are
        few = (left.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_SHINGLES
        left, right = (side.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("shingles").alias(f"s_{s}")) for s, side in (("a", left), ("b", right)))
        both = right.join(F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs, "b").join(F.broadcast(left) if few else left, "a")
        both = both.select(*pairs.columns, "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("inter"))
        out = save(both.withColumn("in", linked(F.col("inter"), F.col("n_a"), F.col("n_b"), self.percent)), "verified")
        for t in (firsts, seconds, whole):
            drop(t)
        return out

    # --- step 1 ---

    def seeds(self) -> tuple[DataFrame, DataFrame]:
        """(seed, id, k) of the seeds that k > 1 documents reach, and (id, n, w, h) of every document: w, how far it reaches
        into its list, and h, how many of those are hot. Either w - h is enough for the prefix rule, or w is all."""
        save, drop, leaf = self.scratch.save, self.scratch.drop, self.leaf
        need = _least(F.col("n"), self.percent)
        reach = save(self.sizes.select("id", "n", "low", F.greatest("low", need).alias("w")), "reach")
        index = self._prefixes()
        grouped = [save(self._prefixes(p).groupBy("seed").agg(F.count("*").alias("k"), F.min("id").alias("a"), F.max("id").alias("b")).where("k > 1"), "regions") for p in range(PARTS)]
        regions = reduce(DataFrame.unionByName, grouped)
        many = save(regions.where("k > 2").select("seed", "k"), "many")
        twos = regions.where("k = 2").select("seed", "k", F.explode(F.array("a", "b")).alias("id"))
        members = save(with_ids(index, many, "seed", "inner").select("seed", "k", "id").unionByName(twos), "members")
        for t in (*grouped, many):
            drop(t)
        # what documents reach beyond BOUND, where only few meet
        far = save(reach.where("w > low").select("id", F.col("low").alias("lo"), F.col("w").alias("hi")), "far")
        beyond = save(ranges(with_ids(self.texts, far, "id", "inner"), self.size), "beyond")
        drop(far)
        reach = reach.select("id", "n", "w")
        while True:
            hot = save(members.where(F.col("k") > leaf).groupBy("id").agg(F.count("*").alias("h")), "hot")
            now = save(with_ids(reach, hot, "id", "left").select("id", "n", "w", F.coalesce("h", F.lit(0)).alias("h")), "reach")
            drop(hot), drop(reach)
            reach = now.select("id", "n", "w")
            grow = save(now.where((F.col("w") - F.col("h") < need) & (F.col("w") < F.col("n"))).select("id", F.col("w").alias("lo"), F.col("n").alias("hi")), "grow")
            if not grow.limit(1).count():
                drop(grow), drop(beyond)
                return members, now
            fresh = save(ranges(with_ids(self.texts, grow, "id", "inner"), self.size), "fresh")
            wide = save(beyond.unionByName(fresh), "beyond")
            # all that hold a fresh seed hold it beyond BOUND; a seed of one document isn't among the members
            both = wide.join(F.broadcast(fresh.select("seed").distinct()), "seed", "left_semi") if fresh.count() <= BROADCAST_IDS else wide
            counts = save(both.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1"), "counts")
            more = with_ids(wide, counts, "seed", "inner").select("seed", "k", "id")
            new = save(with_ids(members, counts.select("seed"), "seed", "left_anti").unionByName(more), "members")
            reach = save(with_ids(reach, grow, "id", "left").select("id", "n", F.coalesce("hi", "w").alias("w")), "reach")
            for t in (now, members, beyond, fresh, counts, grow):
                drop(t)
            members, beyond = new, wide

    def _prefixes(self, part: int | None = None) -> DataFrame:
        """(id, seed) of every document's first shingles: all up to BOUND, and at least as many as the prefix rule asks for; of one part only, if given."""
        percent, parts = self.percent, np.uint64(PARTS)

        def make(columns, s, at):
            n = np.diff(at)
            low = np.diff(np.concatenate([[0], np.cumsum(s.view(np.uint64) <= np.uint64(BOUND))])[at])
            reach = np.maximum(low, n * (100 - percent) // 100 + 1)
            row = np.repeat(np.arange(len(n)), n)
            take = np.arange(len(s)) - np.repeat(at[:-1], n) < reach[row]
            if part is not None:
                take &= s.view(np.uint64) % parts == part
            return [columns[0].take(pa.array(row[take])), pa.array(s[take])]

        return _shingled(self.texts, self.size, "id ID, seed long", make)

    def leaves(self, members: DataFrame, reach: DataFrame, hot: DataFrame) -> DataFrame:
        """Verified pairs of the leaf regions: shared shingles are those counted, at most the fewer hot ones, and at most what
        lies beyond either reach; of two crowded documents, those counted and the hot ones that both hold."""
        groups = members.where(F.col("k") <= self.leaf).groupBy("seed").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        one = groups.select("ids", F.posexplode("ids").alias("i", "a"))
        two = one.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
        pairs = self.scratch.save(two.groupBy("a", "b").agg(F.count("*").alias("c")), "pairs")
        both = pairs
        for s in "ab":
            both = both.join(reach.select(F.col("id").alias(s), *(F.col(x).alias(f"{x}_{s}") for x in "nwh")), s)
        most = F.least("n_a", "n_b", F.col("c") + F.least("h_a", "h_b") + F.greatest(F.col("n_a") - F.col("w_a"), F.col("n_b") - F.col("w_b")))
        first = self.scratch.save(both.where(linked(most, F.col("n_a"), F.col("n_b"), self.percent)).select("a", "b", "c", "n_a", "n_b"), "first")
        both = first
        for s in "ab":
            both = with_ids(both, hot.select(F.col("id").alias(s), F.col("hot").alias(f"c_{s}")), s, "left", BROADCAST_REGIONS)
        sure = linked(F.col("c") + in_both(F.col("c_a"), F.col("c_b")), F.col("n_a"), F.col("n_b"), self.percent)
        kept = self.scratch.save(both.where(F.coalesce(sure, F.lit(True))).select("a", "b"), "leaves")
        out = self.verify(kept)
        self.scratch.drop(pairs), self.scratch.drop(first), self.scratch.drop(kept)
        return out

    # --- step 2 ---

    def crowded(self, members: DataFrame, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(head, id, n, h): regions of documents that lack seeds other than hot ones, rarest hot ones first, as many as the prefix
        rule still asks for; regions with the same smallest document, their head, are one. And (id, hot): each such
        document's hot shingles, all of which it reaches."""
        lacking = self.scratch.save(reach.select("id", "n", "h", (_least(F.col("n"), self.percent) - F.col("w") + F.col("h")).alias("lack")).where("lack > 0"), "lacking")
        mine = with_ids(members.where(F.col("k") > self.leaf), lacking, "id", "inner")
        hot = self.scratch.save(mine.groupBy("id").agg(F.collect_list("seed").alias("hot")), "hot")
        first = F.slice(F.array_sort(F.collect_list(F.struct("k", "seed"))), 1, F.first("lack").cast("int"))
        mine = mine.groupBy("id").agg(first.alias("s"), F.first("n").alias("n"), F.first("h").alias("h")).select("id", "n", "h", F.explode("s.seed").alias("seed"))
        mine = self.scratch.save(mine, "homes")
        heads = self.scratch.save(mine.groupBy("seed").agg(F.min("id").alias("head"), F.count("*").alias("k")).where("k > 1").select("seed", "head"), "heads")
        out = self.scratch.save(mine.join(heads, "seed").select("head", "id", "n", "h").distinct(), "regions")
        for t in (lacking, mine, heads):
            self.scratch.drop(t)
        return out, hot

    def split(self, regions: DataFrame, hot: DataFrame, found: list[DataFrame]) -> None:
        """Adds the links of regions to found, level by level."""
        save, drop, share = self.scratch.save, self.scratch.drop, (100 - self.percent) / 100
        if not regions.limit(1).count():
            return
        # the first level: distances of all documents to the region's pivots, of which the head is one. They are those of sets whose
        # other shingles are all apart: a metric, and the true one for pairs that step 1 hasn't counted
        docs = save(regions.join(hot, "id"), "docs")
        pivots = regions.groupBy("head", F.pmod(F.xxhash64("id"), F.lit(PIVOTS - 1)).alias("part")).agg(F.min("id").alias("a")).select("head", "a")
        pivots = save(pivots.union(regions.select("head", "head")).distinct(), "pivots")
        held = docs.select("head", F.col("id").alias("a"), F.col("n").alias("m"), F.col("hot").alias("own")).join(pivots, ["head", "a"], "left_semi")
        held = save(held.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("a", "m", "own"))).alias("pivots")), "held")
        seen = F.transform("pivots", lambda p: F.struct(p["a"].alias("a"), p["m"].alias("m"), F.when(p["a"] == F.col("id"), F.col("n")).otherwise(in_both(F.col("hot"), p["own"])).alias("both")))
        seen = save(with_ids(docs, held, "head", "inner", BROADCAST_REGIONS).select("head", "id", "n", "h", "hot", seen.alias("seen")), "seen")
        star = seen.select("n", "id", F.explode("seen").alias("s")).where((F.col("s.a") != F.col("id")) & linked(F.col("s.both"), F.col("s.m"), F.col("n"), self.percent))
        found.append(self.verify(save(star.select(F.col("s.a").alias("a"), F.col("id").alias("b")).distinct(), "star")))
        far = lambda s: 1 - s["both"] / (s["m"] + F.col("n") - s["both"])
        cells = seen.withColumn("seen", F.transform("seen", lambda s: F.struct(s["a"].alias("a"), far(s).alias("d"))))
        cells = cells.withColumn("nearest", F.array_min(F.transform("seen", lambda x: F.struct(x["d"].alias("d"), x["a"].alias("a")))))
        # a linked document of another cell is at most twice the radius farther from this cell's pivot than from its own
        around = F.transform(F.filter("seen", lambda x: x["d"] <= F.col("nearest")["d"] + 2 * share + 1e-9), lambda x: x["a"])
        cells = save(cells.select("head", "id", "n", "h", "hot", F.col("seen.d").alias("d"), F.col("nearest")["a"].alias("home"), around.alias("around")), "cells")
        for t in (docs, held, seen):
            drop(t)
        least = cells.groupBy("head").agg(F.min("n").alias("smallest"))
        used = pivots.select("head", F.col("a").alias("id"))
        level = 1
        while True:
            # connected documents need no more links; the largest group of a region is settled, others are open
            comps = components(self.scratch, self._links(found))
            now = save(cells.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "labelled")
            drop(comps)
            counts = now.groupBy("head", "comp").agg(F.count("*").alias("k"))
            top = counts.groupBy("head").agg(F.max(F.struct("k", "comp"))["comp"].alias("top"))
            able = linked(F.col("h"), F.col("n"), F.greatest("smallest", "h"), self.percent)  # h shingles could be shared with some set of the region
            left = now.join(top, "head").join(least, "head").where((F.col("comp") != F.col("top")) & able).select("head", "home", "id")
            left = save(left.join(used, ["head", "id"], "left_anti"), "open")
            if not left.limit(1).count():
                return
            level *= MORE
            chosen = save(left.groupBy("head", "home", F.pmod(F.xxhash64("id"), F.lit(level)).alias("part")).agg(F.min("id").alias("id")).select("head", "id"), "pivots")
            p = now.join(chosen, ["head", "id"], "left_semi").select("head", F.col("home").alias("cell"), F.col("id").alias("a"), F.col("comp").alias("c"), F.col("n").alias("m"), F.col("h").alias("g"), F.col("d").alias("e"), F.col("hot").alias("own"))
            rest = now.join(used, ["head", "id"], "left_anti").select("head", "id", "n", "h", "d", "comp", "hot", F.explode("around").alias("cell"))
            near = F.forall(F.zip_with("d", "e", lambda x, y: F.abs(x - y)), lambda x: x <= share + 1e-9)
            able_ = linked(F.least("g", "h"), F.col("m"), F.col("n"), self.percent)  # cheap, before the shingles are compared
            meet = rest.join(p, ["head", "cell"]).where((F.col("comp") != F.col("c")) & able_ & near & linked(in_both(F.col("hot"), F.col("own")), F.col("m"), F.col("n"), self.percent))
            star = save(meet.select(F.least("a", "id").alias("x"), F.greatest("a", "id").alias("y"), "a").groupBy("x", "y").agg(F.min("a").alias("a")).select("a", F.when(F.col("x") == F.col("a"), F.col("y")).otherwise(F.col("x")).alias("b")), "star")
            found.append(self.verify(star))
            used = save(used.unionByName(chosen), "used")
            drop(now), drop(left)

    def _links(self, found: list[DataFrame]) -> DataFrame:
        out = found[0].where("in").select("a", "b")
        for f in found[1:]:
            out = out.union(f.where("in").select("a", "b"))
        return out

    def links(self) -> DataFrame:
        """(a, b) links that connect exactly what all links connect."""
        members, reach = self.seeds()
        regions, hot = self.crowded(members, reach)
        found = [self.leaves(members, reach, hot)]
        self.split(regions, hot, found)
        return self.scratch.save(self._links(found).distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, key: str = "doc_id", text: str = "text", leaf: int = LEAF, scratch: Scratch | None = None) -> DataFrame:
    """key, n_shingles, component_id of every row: documents link at Jaccard >= percent/100, a component is what links connect.

    component_id is the smallest key reachable, itself included. Texts are lower-cased (A-Z), cut into words at ASCII
    white space and read whole; fewer than `size` words make one shingle. Null, empty and wordless texts have an empty
    set and link with nothing. Equal sets are one class, joined once, so copies make no pairs. Rows that repeat a key
    are documents of their own: each is linked by its own text and gets the smallest key that it reaches. Null keys
    stay single. An empty table gives an empty result; other columns are ignored. docs is read several times, so give a
    table rather than a long plan. The result reads two small saved tables, which stay until the driver
    ends or the caller drops the (new) scratch that it gave.
    """
    own = scratch or Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    meta = own.save(sizes(texts, size), "meta")
    kept = meta.where("n > 0 AND id IS NOT NULL")
    if kept.groupBy("id").count().where("count > 1").limit(1).count():
        return _repeated(texts, meta, percent, size, key, leaf, own)
    classes = own.save(kept.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    # all but each class's smallest id stand aside
    several = own.save(classes.where("copies > 1").select("key", "rep"), "several")
    alone = own.save(with_ids(kept.select("id", "n", "low", "key"), several, "key", "left").where("rep IS NULL OR rep = id").select("id", "n", "low"), "alone")
    aside = own.save(with_ids(kept.select("id", "key"), several, "key", "inner").where("rep <> id").select("id"), "aside")
    found = Join(with_ids(texts.where("id IS NOT NULL"), aside, "id", "left_anti"), alone, own, percent, size, leaf).links()
    comps = components(own, found).withColumnRenamed("id", "rep")
    moved = own.save(classes.join(comps, "rep", "left").where("copies > 1 OR comp IS NOT NULL").select("key", F.coalesce("comp", "rep").alias("comp")), "moved")
    own.keep(meta, moved)
    out = with_ids(meta.select("id", "n", "key"), moved, "key", "left")
    mine = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("comp", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), mine.alias("component_id"))


def _repeated(texts: DataFrame, meta: DataFrame, percent: int, size: int, key: str, leaf: int, scratch: Scratch) -> DataFrame:
    """near_duplicates of rows that repeat keys: each key and text is a document, named by the key and a digest of the text."""
    named = F.concat_ws(":", F.col("id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = scratch.save(texts.where("id IS NOT NULL").select("id", named.alias("name")), "rows")
    once = scratch.save(texts.where("id IS NOT NULL").select(named.alias("name"), "text").dropDuplicates(["name"]), "once")
    deep = Scratch(texts.sparkSession, "jaccard")
    groups = scratch.save(near_duplicates(once, percent, size, "name", "text", leaf, deep), "groups")
    deep.drop(deep.root)
    least = groups.join(rows.distinct(), "name").groupBy("component_id").agg(F.min("id").alias("least"))
    told = scratch.save(groups.join(least, "component_id").select("name", "n_shingles", "least"), "told")
    scratch.keep(rows, meta, told)
    out = rows.join(told, "name").select("id", "n_shingles", "least").union(meta.where("id IS NULL").select("id", "n", "id"))
    return out.toDF(key, "n_shingles", "component_id")
