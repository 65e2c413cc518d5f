"""Operator 1: personal data by patterns plus a semi-Markov conditional random field over whole spans."""

from __future__ import annotations

import math
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import give_back

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the contract. Look-behinds and possessive repeats keep the leftmost matches and make each scan linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one @ after a run of local characters, cut at the end of the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The contract's spans: leftmost and non-overlapping per kind, failing matches dropped; by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the semi-Markov CRF -------------------------------------------------------------------------------------------

#: The bounds of an entity, which make the dynamic program linear: words, characters and digits that a candidate span has at
#: most (a card has 19 digits, a phone number in pairs 8 words). CONTEXT: tokens around a trigger. BUCKETS: of hashed features a kind.
MAX_WORDS, MAX_CHARS, MAX_DIGITS, CONTEXT, BUCKETS = 8, 120, 24, 3, 1 << 12
#: Candidates whose features are held at a time.
BATCH = 1024
_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'.,;:!?"
_CUES = {"phone": "phone", "tel": "phone", "tel.": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "mastercard": "card", "email": "email", "e-mail": "email", "mail": "email", "ip": "ip", "host": "ip", "server": "ip"}


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))


def _features(span: str, words: int, before: str) -> list[int]:
    """Hashed features of a whole candidate span, its word count and the word before it."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    shape = _shape(span)
    named = [f"n{n}", f"w{words}", f"s{shape}", f"t{re.sub(r'[^(9a]', '', shape)}", f"cue{_CUES.get(before.lower().strip(':'), '-')}", f"at{span.count('@')}", f"obf{bool(re.search(r'[\[(](at|AT)[\])]', span))}.{bool(re.search(r'[\[(](dot|DOT)[\])]', span))}"]
    named += [f"luhn{13 <= n <= 19 and luhn(digits)}", f"letters{any(c.isalpha() for c in span)}.{n > 0}", f"first{span[0] if not span[0].isalnum() else 'x'}", f"last{span[-1] if not span[-1].isalnum() else 'x'}"]
    parts = span.split(".")
    named.append(f"quad{len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}")
    named += [f"n{n}w{words}s{shape}"]
    return [zlib.crc32(x.encode()) % BUCKETS for x in named]


class Tokens:
    """Places of a text's words, 18 bytes each: start, end, whether a taken span covers them, and their digits if they hold a trigger."""

    def __init__(self, text: str, taken: list[Span]):
        self.text, self.start, self.end, self.free, self.digits = text, array("q"), array("q"), bytearray(), array("q")
        covered, k = sorted((a, b) for _, a, b in taken), 0
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            while k < len(covered) and covered[k][1] <= a:
                k += 1
            self.start.append(a)
            self.end.append(b)
            self.free.append(not (k < len(covered) and covered[k][0] < b))
            word = m[0]
            self.digits.append(sum("0" <= c <= "9" for c in word) if _TRIGGER.search(word) else -1)

    def windows(self) -> Iterator[tuple[int, int]]:
        """(first, end) of the runs of free tokens around triggers; taken tokens end a run."""
        lo = last = -1
        for i in range(len(self.start)):
            if not self.free[i]:
                if lo >= 0:
                    yield lo, min(i, last + 1 + CONTEXT)
                lo = -1
            elif self.digits[i] >= 0:
                if lo >= 0 and i - last > 2 * CONTEXT:
                    yield lo, last + 1 + CONTEXT
                    lo = -1
                if lo < 0:
                    lo = i
                    while lo > 0 and i - lo < CONTEXT and self.free[lo - 1]:
                        lo -= 1
                last = i
        if lo >= 0:
            yield lo, min(len(self.start), last + 1 + CONTEXT)

    def candidates(self, lo: int, hi: int) -> Iterator[tuple[int, int, int, int, list[int]]]:
        """(first token, end token, start, end, features) of the spans inside the bounds that hold a trigger, by end token."""
        text, start, end = self.text, self.start, self.end
        for j in range(lo, hi):
            digits, any_trigger = 0, False
            for i in range(j, max(lo, j - MAX_WORDS + 1) - 1, -1):
                a, b = start[i], end[j]
                if self.digits[i] >= 0:
                    any_trigger, digits = True, digits + self.digits[i]
                if b - a > MAX_CHARS or digits > MAX_DIGITS:
                    break
                if not any_trigger:
                    continue
                while a < b and text[a] in _EDGE:
                    a += 1
                while b > a and text[b - 1] in _EDGE:
                    b -= 1
                if a < b:
                    before = text[start[i - 1] : end[i - 1]] if i > lo else ""
                    yield i - lo, j + 1 - lo, a, b, _features(text[a:b], j + 1 - i, before)


class Window:
    """The candidates of one run with their features, for training on short lines."""

    def __init__(self, tokens: Tokens, lo: int, hi: int):
        self.n, self.tokens = hi - lo, list(zip(tokens.start[lo:hi], tokens.end[lo:hi], strict=True))
        self.segments = list(tokens.candidates(lo, hi))
        self.matrix = np.array([s[4] for s in self.segments], np.int64).reshape(len(self.segments), -1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return weights[:, self.matrix].sum(2).T  # segments x kinds


def decode(tokens: Tokens, lo: int, hi: int, weights: np.ndarray, margin: float) -> list[Span]:
    """Best segmentation of a run: a token outside scores 0, a span its kind's score less the margin; dynamic program over ends.

    Candidates come by their end, so a state is final when the next end is reached, and features of BATCH candidates are
    held at a time, however long the run is.
    """
    best, back = array("d", [0.0]), {}
    source = tokens.candidates(lo, hi)
    while batch := list(islice(source, BATCH)):
        s = weights[:, np.array([c[4] for c in batch], np.int64)].sum(2).T - margin
        kind, top = s.argmax(1), s.max(1)
        for k in np.flatnonzero(top > 0):
            i, j, a, b, _ = batch[k]
            while len(best) <= j:
                best.append(best[-1])
            if (v := best[i] + float(top[k])) > best[j]:
                best[j], back[j] = v, (i, KINDS[kind[k]], a, b)
    out, j = [], len(best) - 1
    while j > 0:
        if j in back:
            i, name, a, b = back[j]
            out.append((name, a, b))
            j = i
        else:
            j -= 1
    return out[::-1]


def _fit_step(window: Window, gold: list[tuple[int, int, int]], weights: np.ndarray, grad: np.ndarray, rate: float) -> float:
    """One AdaGrad step on the negative log-likelihood of the gold segments (first, end, kind); returns that loss."""
    s = window.scores(weights)
    n, segs = window.n, window.segments
    alpha, beta = np.full(n + 1, -math.inf), np.full(n + 1, -math.inf)
    alpha[0] = beta[n] = 0.0
    total = np.logaddexp.reduce(s, axis=1)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for k, seg in enumerate(segs):
        by_end[seg[1]].append(k)
        by_start[seg[0]].append(k)
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1]] + [alpha[segs[k][0]] + total[k] for k in by_end[j]])
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1]] + [beta[segs[k][1]] + total[k] for k in by_start[i]])
    z = alpha[n]
    wanted = {(i, j): k for i, j, k in gold}
    first, end = np.array([x[0] for x in segs]), np.array([x[1] for x in segs])
    delta = np.exp(alpha[first] + beta[end] - z)[:, None] * np.exp(s - total[:, None]) * np.exp(total)[:, None]
    loss = z
    for k, seg in enumerate(segs):
        if (seg[0], seg[1]) in wanted:
            delta[k, wanted[seg[0], seg[1]]] -= 1
            loss -= s[k, wanted[seg[0], seg[1]]]
    for c in range(len(KINDS)):
        g = np.bincount(window.matrix.ravel(), np.repeat(delta[:, c], window.matrix.shape[1]), BUCKETS) + 1e-4 * weights[c]
        grad[c] += g * g
        weights[c] -= rate * g / np.sqrt(grad[c])
    return loss


def _example(rng: random.Random) -> tuple[str, list[tuple[str, str]]]:
    """A made-up labelled line: invented words around entities in the base forms and in variants, and look-alikes left unlabelled."""
    word = lambda: "".join(rng.choice(["an", "th", "er", "ion", "le", "que", "sch", "ou", "la", "ci"]) for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = rng.choice("3456") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def entity() -> tuple[str, str]:
        k = rng.randrange(9)
        user, host = f"{word()}{rng.choice(['.', '_', ''])}{num(rng.randint(0, 2))}".strip("._"), f"{word()}{num(rng.randint(0, 1))}"
        tld = rng.choice(["com", "org", "net", "de"])
        if k == 0:
            return f"{user}@{host}.{tld}", "email"
        if k == 1:
            return rng.choice([f"{user} (at) {host} (dot) {tld}", f"{user} [at] {host} [dot] {tld}", f"{user}[at]{host}[dot]{tld}", f"{user}(at){host}(dot){tld}"]), "email"
        if k == 2:
            return ".".join(str(rng.randint(1, 255)) for _ in range(4)), "ip"
        if k == 3:
            return card(), "card"
        if k == 4:
            c = card()
            return rng.choice([" ", "-", ".", "/"]).join(c[i : i + 4] for i in range(0, 16, 4)), "card"
        if k == 5:
            return f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", "phone"
        if k == 6:
            return rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}"]), "phone"
        if k == 7:
            return f"+{num(rng.randint(10, 12))}", "phone"
        pairs = " ".join(num(2) for _ in range(4))
        return rng.choice([f"00{rng.randint(30, 49)} {num(3)} {num(4)} {num(3)}", f"00{rng.randint(30, 49)} {num(1)} {pairs}", f"0{num(1)} {pairs}"]), "phone"

    def decoy() -> str:
        return rng.choice([num(rng.randint(1, 8)), num(16), f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), f"{word()}{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"@{word()}", f"#{num(4)}", f"{num(1)},{num(3)}", f"{num(2)}%", f"${num(3)}.{num(2)}", num(24), f"{num(1)} {num(1)} {num(1)} {num(1)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(5)} {num(5)} {num(5)}", f"{num(2)} {num(2)}", f"{num(3)} {num(3)}"])

    parts, gold = [], []
    for _ in range(rng.randint(1, 2)):
        parts += [word() for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.5:
            text, kind = entity()
            if rng.random() < 0.3:
                parts.append(rng.choice([c for c, k in _CUES.items() if k == kind]))
            gold.append((text, kind))
            parts.append(text + rng.choice(["", "", ",", "."]))
        else:
            parts.append(decoy() + rng.choice(["", ",", "."]))
    return " ".join([*parts, *(word() for _ in range(rng.randint(1, 3)))]), gold


@lru_cache(maxsize=2)
def train(examples: int = 1500, epochs: int = 8, seed: int = 11, rate: float = 0.3) -> np.ndarray:
    """Weights (kinds x buckets) fitted on made-up labelled lines; bounded by `examples`, the same in every process."""
    rng = random.Random(seed)
    data = []
    for _ in range(examples):
        text, gold = _example(rng)
        spans, at = [], 0
        for entity, kind in gold:
            a = text.index(entity, at)
            at = a + len(entity)
            spans.append((a, at, KINDS.index(kind)))
        tokens = Tokens(text, [])
        for w in (Window(tokens, lo, hi) for lo, hi in tokens.windows()):
            starts, ends = {a: i for i, (a, _) in enumerate(w.tokens)}, {}
            for j, (a, b) in enumerate(w.tokens):
                ends.update({e: j + 1 for e in range(a + 1, b + 1)})
            labels = [(starts[a], ends[b], k) for a, b, k in spans if a in starts and b in ends]
            if w.segments and all(j - i <= MAX_WORDS for i, j, _ in labels):
                data.append((w, labels))
    weights, grad = np.zeros((len(KINDS), BUCKETS)), np.full((len(KINDS), BUCKETS), 1e-6)
    for _ in range(epochs):
        rng.shuffle(data)
        for w, labels in data:
            _fit_step(w, labels, weights, grad, rate)
    return weights.astype(np.float32)


def find(text: str, weights: np.ndarray, margin: float = 2.0) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the field adds clear of them), each by kind, then start."""
    base = base_spans(text)
    tokens = Tokens(text, base)
    added = [s for lo, hi in tokens.windows() for s in decode(tokens, lo, hi, weights, margin)]
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


# --- over a table --------------------------------------------------------------------------------------------------

_MAYBE = r"[0-9@]|[\[(](at|AT)[\])]"


def _merge(base: list[Span], added: list[Span]) -> list[Span]:
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _write(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact_text(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        elif b <= end:
            continue
        end = max(end, b)
    return "".join([*out, text[end:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", margin: float = 2.0) -> DataFrame:
    """key, n_<kind> (base spans), base (written spans), spans (base and added), n_added of every row; no shuffle.

    Null and empty texts have none. Texts are searched whole; offsets are code points. Repeated rows count each; an empty
    table gives an empty result; other columns are ignored. Only the key and the text reach Python, and only texts that
    hold a digit, an @ or a written "(at)" are looked at there one by one. Spans of the field are bounded (MAX_WORDS,
    MAX_CHARS, MAX_DIGITS), texts are not: memory is some 50 bytes a word of the longest text.
    """
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            n = len(column)
            counts, base, spans, more = np.zeros((len(KINDS), n), np.int64), [""] * n, [""] * n, np.zeros(n, np.int64)
            for i in np.flatnonzero(pc.match_substring_regex(column, _MAYBE).to_numpy(zero_copy_only=False)):
                found, added = find(column[int(i)].as_py(), weights, margin)
                for k, _, _ in found:
                    counts[KINDS.index(k), i] += 1
                base[i], spans[i], more[i] = _write(found), _write(_merge(found, added)), len(added)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(more)], names=names)
        batch = column = None
        give_back()

    names = ["key", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"]
    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, n_added long")
    return out.withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", margin: float = 2.0) -> DataFrame:
    """docs with every found span replaced by its kind, as [EMAIL]; null texts stay null, other columns stay as they are."""
    weights, at = train(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            hit = np.flatnonzero(pc.match_substring_regex(pc.fill_null(column, ""), _MAYBE).to_numpy(zero_copy_only=False))
            if len(hit):
                rest = {int(i): redact_text(t, _merge(*find(t, weights, margin))) for i in hit for t in [column[int(i)].as_py()]}
                values = np.zeros(len(column), bool)
                values[hit] = True
                column = pc.replace_with_mask(column, pa.array(values), pa.array([rest[int(i)] for i in hit], column.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], schema=batch.schema)
        batch = column = rest = None
        give_back()

    return docs.mapInArrow(run, docs.schema)
