"""Operator 11 against a plain count and all pairs at distance one."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from tidecast.llm import queries, spelling
from tidecast.llm.common import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows, every=97, shortest=5, least=3):
    counts = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            word = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            counts[word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}


def plain_variants(counts):
    near, stars = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            stars[w[:i] + "*" + w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in counts:
                near[w].add(shorter), near[shorter].add(w)
    for ws in stars.values():
        for w in ws:
            near[w] |= ws - {w}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= 2 * counts[w]}
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return out


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1 :]
        yield word[:i] + word[i + 1 :]


def test_words_at_distance_one_share_a_key():
    """Every edit of random words over two letters, where bigrams repeat most, under random bigram orders."""
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(5, 10)))
        others = {o for o in edits(word, "abc") if o != word and len(o) >= 4}
        grams = sorted({w[i : i + 2] for w in [word, *others] for i in range(len(w) - 1)})
        rng.shuffle(grams)
        order = {g: i for i, g in enumerate(grams)}
        mine = dict.fromkeys(spelling.word_keys(word, order))
        for other in others:
            x, y = (mine, dict.fromkeys(spelling.word_keys(other, order)))
            x, y = (x, y) if len(word) <= len(other) else (y, x)
            assert {k for k, longer in x if not longer} & {k for k, longer in y if longer == (len(word) != len(other))}, (word, other)


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i if i else None, " ".join("".join(rng.choice("abBÀé") for _ in range(rng.randint(4, 7))) for _ in range(500)) if i % 20 else None) for i in range(60)]
    rows += [(7, "x" * 50_000 + " " + "x" * 50_000 + "-" + "X" * 50_000), (8, ""), (9, "naïve naïve NAÏVE naîve×÷ naîve×÷ naîve×÷"), (9, "naïve naïve NAÏVE")]
    frame = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "doc_id long, text string, word string, n int, run string")
    got = {tuple(r) for r in spelling.variants(frame).collect()}
    assert got == plain_variants(plain_words(rows)) and len(got) > 1000 and any(f and r != f for _, f, r, *_ in got)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_the_query_over_its_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op11_spelling_variants(spark, data).collect()} == plain_variants(plain_words(rows))


def test_candidates_stay_near_the_number_of_pairs(spark, data):
    """What meets under a key is nearly always a true pair: keys hold what an edit leaves alone, not only a bigram."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    words = spark.createDataFrame(spelling.words(docs).collect(), "word string, n long")
    order = spelling.bigram_order(words)
    held = defaultdict(lambda: ([], []))
    for (w,) in words.select("word").collect():
        for key, longer in dict.fromkeys(spelling.word_keys(w, order)):
            held[key][longer].append(w)
    meetings = sum(len(a) * (len(a) - 1) // 2 + len(a) * len(b) for a, b in held.values())
    n = words.count()
    assert meetings < 0.02 * n * n / 2 and max(len(a) + len(b) for a, b in held.values()) < 0.1 * n


def test_no_join_broadcasts_by_a_guessed_size(spark, data):
    """Keyed words are many times the saved words from which Spark takes their size, so the driver would hold them all."""
    plans = []

    class Seen(Scratch):
        def save(self, df, name="t"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, name)

    out = spelling.variants(spark.read.parquet(f"{data}/documents.parquet"), scratch=Seen(spark, "seen"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]
