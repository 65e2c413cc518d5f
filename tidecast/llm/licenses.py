"""Operator 4: licence texts found by MinHash bands over overlapping windows, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Words, chunks

#: Whole texts of longer public licences.
FOLDER = Path(__file__).parent / "licence_texts"
# Notices, sentences and whole short texts of well-known public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-warranty": 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Whole texts of short public licences, some of which hold a notice above.
TEXTS = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE."
    ),
}


def _shingles(text: str, size: int) -> np.ndarray:
    raw = text.encode()
    return np.unique(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), trim=True).windows(size)[0])


class Bands:
    """One class of templates of like length: windows of two blocks of `stride` shingles, so a template lies in one window.

    With one row a band, a window and a template of Jaccard similarity J meet in some of b bands with probability
    1 - (1 - J)^b. A window that holds `containment` of a template of n shingles has J >= containment * n / (2 stride + n),
    and b is the least number for which that probability reaches `certainty`.
    """

    def __init__(self, templates: Mapping[str, np.ndarray], containment: float, certainty: float, seed: int):
        self.names = list(templates)
        self.sets = [templates[n] for n in self.names]
        self.stride = max(len(s) for s in self.sets)
        j = min(containment * len(s) / (2 * self.stride + len(s) * (1 - containment)) for s in self.sets)
        self.count = int(np.ceil(np.log(1 - certainty) / np.log(1 - j)))
        rng = np.random.RandomState(seed)
        self.odd = rng.randint(1, 2**62, self.count).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.want = np.array([[(s * o).min() for s in self.sets] for o in self.odd])

    def find(self, h: np.ndarray, doc: np.ndarray, place: np.ndarray, containment: float) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """By template, the documents with a window that holds enough of it: (documents, template, containments, first shingles).

        All windows that met are verified together; a shingle lies in two windows at most, so memory follows the batch.
        """
        block = place // self.stride
        start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])]))
        joined = np.zeros(len(start), bool)
        joined[:-1] = doc[start[1:]] == doc[start[:-1]]
        near = np.concatenate([np.arange(1, len(start)), [0]])
        hit = np.zeros((len(self.sets), len(start)), bool)
        for odd, want in zip(self.odd, self.want, strict=True):
            low = np.minimum.reduceat(h * odd, start)
            low = np.where(joined, np.minimum(low, low[near]), low)
            for t in range(len(self.sets)):
                hit[t] |= low == want[t]
        stop = np.concatenate([start[1:], [len(h)]])
        end = np.where(joined, stop[near], stop)
        for name, own, met in zip(self.names, self.sets, hit, strict=True):
            b = np.flatnonzero(met)
            if not len(b):
                continue
            length = end[b] - start[b]
            window = np.repeat(np.arange(len(b)), length)
            at = np.arange(len(window)) + np.repeat(start[b] - (np.cumsum(length) - length), length)
            nth = np.minimum(np.searchsorted(own, h[at]), len(own) - 1)
            held = own[nth] == h[at]
            window, at, nth = window[held], at[held], nth[held]
            share = np.bincount(np.unique(window * len(own) + nth) // len(own), minlength=len(b)) / len(own)
            enough = np.flatnonzero(share >= containment)
            if not len(enough):
                continue
            first = at[np.searchsorted(window, enough)]
            d = doc[start[b[enough]]]
            lead = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            yield d[lead], name, np.maximum.reduceat(share[enough], lead), place[np.minimum.reduceat(first, lead)]


def pack(folder: str | Path = FOLDER) -> dict[str, str]:
    """Templates from a folder of whole licence texts, a <name>.txt each: few files, read on the driver that hashes them."""
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.txt"))}


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, containment: float = 0.75, certainty: float = 0.999, size: int = 5, key: str = "doc_id", text: str = "text", seed: int = 29) -> DataFrame:
    """key, license, containment, first_word: a row for each document and template it holds; no shuffle.

    Words are lower-cased (A-Z) and stripped of ASCII punctuation at their edges. containment is the largest share of the
    template's shingles inside one window, first_word where (in words) the first such window's match begins. Whole texts;
    null, empty and shorter texts hold nothing; templates under `size` words raise. Repeated rows each give their rows, a
    text that repeats a notice gives one; an empty table gives an empty result. The templates (notices, short texts and the
    pack of whole licences, unless given) are a parameter that every task holds, not data.
    """
    templates = TEMPLATES | TEXTS | pack() if templates is None else templates
    sets = {n: _shingles(t, size) for n, t in templates.items()}
    if not all(len(s) for s in sets.values()):
        raise ValueError(f"templates need at least {size} words")
    classes: dict[int, dict[str, np.ndarray]] = {}
    for name, s in sets.items():
        classes.setdefault(int(len(s)).bit_length(), {})[name] = s
    bands = [Bands(c, containment, certainty, seed + k) for k, c in sorted(classes.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in chunks(batch.column(1)):
                w = Words(data, off, trim=True)
                h, doc = w.windows(size)
                if not len(h):
                    continue
                place = np.arange(len(h)) - np.searchsorted(doc, doc)
                for d, name, share, at in (f for b in bands for f in b.find(h, doc, place, containment)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + d)), pa.array([name] * len(d)), pa.array(share), pa.array(at.astype(np.int64))], names=["key", "license", "containment", "first_word"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {kind}, license string, containment double, first_word long")
    return out.withColumnRenamed("key", key)
