"""Operator 2: URL filters. Rules first, then empirical-Bayes host reputation from labelled page outcomes. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path): the rules of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Suffixes of two labels; every other suffix is the last label. A parameter, not a full public list.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first :// up to / ? # or the end; path then up to ? # or the end; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits host (or a parent domain of it) and path; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def levels(df: DataFrame, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """df with domain (registered: one label before the suffix) and suffix of its host, a port left out; a bare suffix is its own domain."""
    name = F.regexp_replace("host", r":[0-9]*$", "")
    last_two = F.substring_index(name, ".", -2)
    two = last_two.isin(*suffixes) if suffixes else F.lit(False)
    return df.withColumn("suffix", F.when(two, last_two).otherwise(F.substring_index(name, ".", -1))).withColumn("domain", F.when(two, F.substring_index(name, ".", -3)).otherwise(last_two))


def _strength(lowest: float = 1.0, highest: float = 1000.0) -> Column:
    """Prior observations of a level by moments: the spread of its groups' good counts about their parents' means."""
    chance = F.col("parent") * (1 - F.col("parent"))
    spread = F.sum(F.pow(F.col("good") - F.col("n") * F.col("parent"), 2) / F.col("n") - chance)
    rho = F.try_divide(spread, F.sum(chance * (F.col("n") - 1)))
    return F.greatest(F.lit(lowest), F.least(F.lit(highest), F.coalesce(F.try_divide(1 - rho, F.when(rho > 0, rho)), F.lit(highest))))


def reputation(labelled: DataFrame, root: float = 0.5, root_strength: float = 2.0) -> DataFrame:
    """(level, name, mean, strength) of the levels root, suffix, domain and host, from (host, domain, suffix, good 0/1).

    A group's mean is its good outcomes plus its parent's mean times the level's prior strength, over its outcomes plus
    that strength. Groups grow with the hosts seen, not with the pages; every count is partially aggregated.
    """
    scratch = Scratch(labelled.sparkSession, "hosts")
    hosts = scratch.save(labelled.groupBy("suffix", "domain", "host").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("good")))
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"))
    whole = whole.select(F.lit("root").alias("level"), F.lit("").alias("name"), "n", "good", ((F.col("good") + root * root_strength) / (F.col("n") + root_strength)).alias("mean"), (F.col("n") + root_strength).alias("strength"))
    out = parent = scratch.save(whole)
    above = None
    for level in ("suffix", "domain", "host"):
        keys = [F.col(level).alias("name"), (F.col(above) if above else F.lit("")).alias("up")]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        groups = scratch.save(groups.join(parent.select(F.col("name").alias("up"), F.col("mean").alias("parent")), "up"))
        prior = F.lit(groups.agg(_strength().alias("prior")).first()[0])  # one number
        groups = groups.select(F.lit(level).alias("level"), "name", "n", "good", ((F.col("good") + prior * F.col("parent")) / (F.col("n") + prior)).alias("mean"), (F.col("n") + prior).alias("strength"))
        parent = scratch.save(groups)
        out, above = out.unionByName(parent), level
    return out


def bound(mean: Column, strength: Column, z: float) -> Column:
    """Lower posterior bound of a beta with this mean and strength: mean less z posterior standard deviations, at least 0."""
    return F.greatest(F.lit(0.0), mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (strength + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES, threshold: float = 0.5, z: float = 1.645, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score, level) of every page; outcomes: (key, good 0/1) of labelled pages.

    The longest fitting rule decides; else the lower posterior bound (z: one-sided 95 %) of the host's reputation, or
    that of its domain, suffix or the whole where the host, domain or suffix has no labelled page, against threshold.
    suffixes: those of more than one label, for example from the public suffix list.
    Null urls and urls without :// have an empty host and are judged like it. Repeated pages count each; outcomes of
    unknown pages or with null are left out. No pages: no rows. No outcomes: the root prior judges.
    """
    host, path = host_and_path(F.col(url))
    seen = levels(pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")), suffixes)
    scratch = Scratch(pages.sparkSession, "judge")
    seen = scratch.save(seen)
    good = outcomes.select(F.col(key).alias("key"), F.col("good").cast("int").alias("good")).where("good is not null")
    known = scratch.save(reputation(seen.join(good, "key")))
    # by host: the hosts of all pages, a row each, so that a hot host's pages don't meet in a window
    hosts = seen.select("host", "domain", "suffix").distinct()
    for level in ("host", "domain", "suffix"):
        part = known.where(F.col("level") == level).select(F.col("name").alias(level), F.struct(F.lit(level).alias("level"), "mean", "strength").alias(f"by_{level}"))
        hosts = hosts.join(part, level, "left")
    root = known.where("level = 'root'").first()
    by_root = F.struct(F.lit("root").alias("level"), F.lit(root["mean"]).alias("mean"), F.lit(root["strength"]).alias("strength"))
    hosts = hosts.select("host", F.coalesce("by_host", "by_domain", "by_suffix", by_root).alias("r"))
    hosts = scratch.save(hosts.select("host", bound(F.col("r.mean"), F.col("r.strength"), z).alias("score"), F.col("r.level").alias("level")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = seen.select("key", "host", "path", rule.alias("rule"), verdict.alias("ruled")).join(hosts, "host")
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score", "level")
