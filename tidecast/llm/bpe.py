"""Operator 3: byte-level BPE encoding and decoding with a rank queue of hierarchical bitmaps."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .words import give_back

#: Bytes of a batch that are turned into Python strings at a time.
SLICE_BYTES = 4 << 20
#: Bytes above which a pre-token is merged alone.
LONG = 256


#: Ranks that one word of the lower bitmap covers; the upper bitmap has a bit for each word.
WORD_BITS = 8
_BIT = [1 << k for k in range(1 << WORD_BITS)]
_MASK = len(_BIT) - 1


class Codec:
    """Encoder and decoder of one rank file; the pre-token pattern and the file's place are parameters."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.ranks.items()}
        self.low = [0] * ((max(self.ranks.values()) >> WORD_BITS) + 1)
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, tuple[str, int, bytes]] = {}
        self.written = [str(r) for r in range(max(self.token) + 1)]
        splits = {(self.ranks[t[:k]], self.ranks[t[k:]]): r for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        keys = np.array([a * len(self.ranks) + b for a, b in splits], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_values = keys[order], np.array(list(splits.values()), np.int64)[order]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked adjacent pair merges first, the leftmost among equals, until none is left.

        The pending merges are a rank queue: a bucket of linked-list positions per rank, and a two-level bitmap in which
        a bit says that a rank's bucket (or a word of ranks) isn't empty. Find-first-set on the upper level, then on the
        word, gives the lowest pending rank in two steps, however long the piece is. Buckets are heaps, as equal ranks
        merge leftmost first. An entry whose pair has changed since it was queued is stale and skipped. Written out in
        one function, as it runs once for every distinct pre-token.
        """
        find = self.ranks.get
        whole = find(piece)
        if whole is not None:
            return [whole]
        n, low, top = len(piece), self.low, 0
        buckets: dict[int, list[int]] = {}
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
        back = list(range(-1, n))  # back[i]: where the part before i starts
        pair = [-1] * n  # pair[i]: the rank of the part at i joined with the next one; -1: no merge, or i is merged away
        for i in range(n - 1):
            r = find(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so still a heap
                else:
                    buckets[r] = [i]
                    low[r >> WORD_BITS] |= _BIT[r & _MASK]
                    top |= 1 << (r >> WORD_BITS)
        while top:
            w = (top & -top).bit_length() - 1
            word = low[w]
            bit = word & -word
            r = (w << WORD_BITS) + bit.bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                low[w] = word = word ^ bit
                if not word:
                    top &= top - 1
            if pair[i] != r:
                continue  # stale
            j = end[i]
            end[i] = e = end[j]
            pair[i] = pair[j] = -1
            fresh = []
            if e < n:
                back[e] = i
                if (r := find(piece[i : end[e]])) is not None:
                    pair[i] = r
                    fresh.append((r, i))
            if i:
                b = back[i]
                pair[b] = -1
                if (r := find(piece[b:e])) is not None:
                    pair[b] = r
                    fresh.append((r, b))
            for r, at in fresh:
                if r in buckets:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    low[r >> WORD_BITS] |= _BIT[r & _MASK]
                    top |= 1 << (r >> WORD_BITS)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() of many pre-tokens at once: one rank queue over all of them, each step merging in many pieces together.

        Pieces lie end to end; a bucket then holds positions of many pieces, and of the lowest pending rank each piece
        merges its leftmost pair. Pieces don't touch, so every piece sees the very order of merge(). A word of the lower
        bitmap keeps its entries together, sorted when the word comes up; entries for later words wait in an inbox.
        """
        lengths = np.array([len(p) for p in pieces], np.int64)
        n = int(lengths.sum())
        if not n:
            return [[] for _ in pieces]
        first = np.concatenate([[0], np.cumsum(lengths)])
        part = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first[1:][lengths > 0] - 1] = -1
        before[first[:-1][lengths > 0]] = -1
        pair = np.full(n, -1, np.int64)
        at = np.flatnonzero(after >= 0)
        pair[at] = self.pair_ranks(part[at], part[after[at]])
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        top = 0

        def deal(ranks: np.ndarray, at: np.ndarray, buckets: dict[int, list[np.ndarray]]) -> int:
            """Puts the entries of one word into its buckets; returns the bits of those."""
            bits = 0
            if len(ranks):
                order = np.lexsort((at, ranks))
                ranks, at = ranks[order], at[order]
                edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
                for x, y in zip(edges, edges[1:]):
                    r = int(ranks[x])
                    buckets.setdefault(r, []).append(at[x:y])
                    bits |= _BIT[r & _MASK]
            return bits

        inbox = [(pair[at][pair[at] >= 0], at[pair[at] >= 0])]
        while True:
            inbox = [x for x in inbox if len(x[1])]
            if inbox:  # deal the inbox out to the words of the lower bitmap
                ranks, at = np.concatenate([x[0] for x in inbox]), np.concatenate([x[1] for x in inbox])
                inbox = []
                order = np.argsort(ranks >> WORD_BITS, kind="stable")
                ranks, at = ranks[order], at[order]
                words, starts = np.unique(ranks >> WORD_BITS, return_index=True)
                for w, x, y in zip(words.tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)], strict=True):
                    waiting.setdefault(w, []).append((ranks[x:y], at[x:y]))
                    top |= 1 << w
            if not top:
                break
            w = (top & -top).bit_length() - 1
            top &= top - 1
            held = waiting.pop(w)
            ranks, at = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            buckets: dict[int, list[np.ndarray]] = {}
            word = deal(ranks, at, buckets)
            while word:
                r = (w << WORD_BITS) + (word & -word).bit_length() - 1
                word &= word - 1
                got = buckets.pop(r)
                i = got[0] if len(got) == 1 else np.sort(np.concatenate(got))
                i = i[pair[i] == r]  # the rest is stale
                if len(i) > 1:
                    o = owner[i]
                    lead = np.ones(len(i), bool)
                    lead[1:] = o[1:] != o[:-1]
                    if not lead.all():
                        buckets[r] = [i[~lead]]
                        word |= _BIT[r & _MASK]
                        i = i[lead]
                elif not len(i):
                    continue
                j = after[i]
                e = after[j]
                part[i] = r
                pair[i] = pair[j] = part[j] = -1
                after[i] = e
                has = e >= 0
                right, left = i[has], before[i]
                before[e[has]] = right
                lo = np.concatenate([right, left[left >= 0]])
                pair[lo] = new = self.pair_ranks(part[lo], part[after[lo]])
                found = new >= 0
                new, lo = new[found], lo[found]
                where = new >> WORD_BITS
                later = where > w
                if not later.all():
                    same = where == w
                    word |= deal(new[same], lo[same], buckets)
                    if (where < w).any():  # a lower word is next; what is left of this one waits
                        inbox += [(np.full(sum(map(len, v)), k), np.concatenate(v)) for k, v in buckets.items()]
                        inbox.append((new[~same], lo[~same]))
                        break
                    new, lo = new[later], lo[later]
                inbox.append((new, lo))
        alive = np.flatnonzero(part >= 0)
        ids = part[alive].tolist()
        cut = np.searchsorted(alive, first).tolist()
        return [ids[x:y] for x, y in zip(cut, cut[1:])]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of part ids joined, -1 where the join is no token."""
        key = left * len(self.ranks) + right
        slot = np.searchsorted(self.pair_keys, key)
        slot[slot == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[slot] == key, self.pair_values[slot], -1)

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.finditer(text) for i in self.merge(m[0].encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def learn(self, texts: list[str]) -> dict[str, tuple[str, int, bytes]]:
        """(ids joined by commas, their number, decoded bytes) of every distinct part of the texts.

        A text is cut before white space, where no pre-token of the pattern reaches across. Most parts of a corpus recur,
        so the parts of one slice are kept for the next; pre-tokens of new parts are merged together, very long ones alone.
        """
        need: set[str] = set()
        for t in texts:
            need.update(_CUT.findall(t))
        self.kept = {p: self.kept[p] for p in need if p in self.kept}
        need.difference_update(self.kept)
        split = {p: [m.encode() for m in self.pattern.findall(p)] for p in need}
        fresh = list({m for ms in split.values() for m in ms if len(m) <= LONG})
        merged = dict(zip(fresh, self.merge_all(fresh), strict=True))
        written = self.written
        for p, ms in split.items():
            ids = [i for m in ms for i in (merged[m] if len(m) <= LONG else self.merge(m))]
            self.kept[p] = ",".join([written[i] for i in ids]), len(ids), self.decode(ids)
        return self.kept


# White space as the pattern's \s has it (fixed by Unicode), which re's own \s isn't.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """The column's strings, a few MB at a time; null: empty."""
    column = pc.fill_null(column, "")
    total = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE_BYTES, "right")) - 1)
        yield column.slice(i, j - i).to_pylist()
        i = j


def _over(docs: DataFrame, key: str, text: str, row: Callable, fields: list[tuple[str, str, pa.DataType]], path: str, pattern: str) -> DataFrame:
    """A narrow map of (key, text) through the worker's codec; row gives the fields of one text from its encoded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        gc.disable()  # millions of small objects and no cycles among them
        try:
            for batch in batches:
                at = 0
                for texts in _slices(batch.column(1)):
                    known = tool.learn(texts)
                    rows = [row([known[p] for p in _CUT.findall(t)]) for t in texts]
                    known = None
                    arrays = [pa.array([r[k] for r in rows], f[2]) for k, f in enumerate(fields)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *arrays], names=["key", *(f[0] for f in fields)])
                    at += len(texts)
        finally:
            batch = texts = rows = arrays = None
            tool.kept = {}
            gc.enable()
            give_back()

    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in fields))
    return out.withColumnRenamed("key", key)


def _digests(parts: list[tuple[str, int, bytes]]) -> tuple[int, str, str]:
    ids, counts, decoded = zip(*parts, strict=True) if parts else ((), (), ())
    return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes) of every row.

    Whole texts, null as empty (no ids); repeated rows count each; an empty table gives an empty result; other columns
    are ignored. No shuffle: a worker reads the rank file once and keeps the encoded parts of one slice of texts. The path must
    exist on every executor.
    """
    return _over(docs, key, text, _digests, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], path, pattern)


def _encoded(parts: list[tuple[str, int, bytes]]) -> tuple[list[int], int]:
    ids = [int(i) for p in parts for i in p[0].split(",")]
    return ids, len(ids)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, n_tokens of every row, under the same rules as digests()."""
    return _over(docs, key, text, _encoded, [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "long", pa.int64())], path, pattern)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, bytes of every row's ids (null: empty); an id that the rank file lacks raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["key", "bytes"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids").mapInArrow(run, f"key {kind}, bytes binary").withColumnRenamed("key", key)
