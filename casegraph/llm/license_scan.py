"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates are sets of 5-word shingles (lower-cased runs of word characters). A template of t shingles belongs to the smallest window size
of 1, 2, 4, ... that is 1.25 t or more (1 for a single shingle), and texts are cut into windows of each size in use, a quarter of the size apart. So
some window holds any copy whole, and with 80 % of the template there its Jaccard similarity is 0.8 * t / (2.5 t) = 0.32 or more. Signatures of
``BANDS`` bands of one row then meet with probability 1 - (1 - 0.32)**32 > 0.99999.

With bands of one row a window meets a template only through a shingle they share. So windows without a template shingle are passed over
before any signature is computed, which loses nothing. A retrieved template is reported where ``min_containment`` of its shingles stand in the window and its
surroundings of the same length.

Templates are a parameter: a list whose size the caller bounds, broadcast with the task. Matching needs no shuffle beyond one row for each (document, license) found.

Defined results: null, empty and short texts match nothing; repeated rows give one result for each doc_id; a null doc_id is reported as null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import table

TOKEN = re.compile(r"\w+")
SHINGLE, BANDS = 5, 32
MIN_CONTAINMENT = 0.8
_P = np.random.default_rng(6).integers(1, 1 << 63, BANDS, np.uint64) | np.uint64(1)

# Notices as their licenses publish them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
]
#: Characters of templates that are sent to the tasks at once.
BLOCK_CHARS = 1 << 22


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 6)
        return h


def shingles(text: str | None, known: dict) -> np.ndarray:
    """Hashes of the text's 5-word shingles, in places."""
    words = TOKEN.findall((text or "").lower())
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return out ^ (out >> np.uint64(29))


def signature(x: np.ndarray) -> np.ndarray:
    return ((x[:, None] ^ (x[:, None] >> np.uint64(31))) * _P[None, :]).min(axis=0)


def window_size(t: int) -> int:
    return 1 if t == 1 else 1 << int(np.ceil(np.log2(1.25 * t)))


class Index:
    """Templates by window size and band value."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        known = _Words()
        self.names = [name for name, _ in templates]
        self.sets = [np.unique(shingles(text, known)) for _, text in templates]
        if any(not len(s) for s in self.sets):
            raise ValueError("a template has fewer words than a shingle")
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = {}
        for i, s in enumerate(self.sets):
            by_band = self.bands.setdefault(window_size(len(s)), {})
            for b, v in enumerate(signature(s).tolist()):
                by_band.setdefault((b, v), []).append(i)
        self.all = np.unique(np.concatenate(self.sets))

    def scan(self, x: np.ndarray, min_containment: float) -> dict[int, tuple[float, int]]:
        """template -> (best containment, first word of the window that shows it)."""
        place = np.minimum(np.searchsorted(self.all, x), len(self.all) - 1)
        hits = np.flatnonzero(self.all[place] == x)
        found: dict[int, tuple[float, int]] = {}
        if not len(hits):
            return found
        for size, by_band in self.bands.items():
            step = max(1, size // 4)
            first = np.maximum(0, -(-(hits - size + 1) // step))
            starts = np.unique(np.concatenate([first + k for k in range(-(-size // step))]))
            for s in (starts * step).tolist():
                window = x[s : s + size]
                if not len(window):
                    continue
                near = {t for b, v in enumerate(signature(window).tolist()) for t in by_band.get((b, v), ())}
                for t in near:
                    region = x[max(0, s - size) : s + 2 * size]
                    share = float(np.isin(self.sets[t], region).mean())
                    if share >= min_containment and share > found.get(t, (0.0, 0))[0]:
                        found[t] = (share, s)
        return found


def blocks(templates: list[tuple[str, str]], limit: int = BLOCK_CHARS) -> list[list[tuple[str, str]]]:
    """The templates in runs of ``limit`` characters at most (or one template): each is scanned for in a pass of its own."""
    out, size = [[]], 0
    for name, text in templates:
        if out[-1] and size + len(text) > limit:
            out.append([])
            size = 0
        out[-1].append((name, text))
        size += len(text)
    return out


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word): the licenses each document names, with the best template's containment."""

    def part(block: list[tuple[str, str]]) -> DataFrame:
        return narrow.mapInArrow(lambda batches: run(batches, block), "doc_id long, license string, containment double, first_word long")

    def run(batches: Iterator[pa.RecordBatch], block: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        index, known = Index(block), _Words()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc, index.names[t], share, at) for t, (share, at) in index.scan(shingles(text, known), min_containment).items()]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "containment", "first_word"])

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    found = reduce(DataFrame.unionByName, [part(block) for block in blocks(templates)])
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("at"))).alias("b")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.at")).alias("first_word"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
