"""License scan: MinHash bands over text windows retrieve templates, exact shingle
containment verifies them.

Words are runs of ASCII letters (A-Z as a-z), digits and bytes from 0x80 on; a
shingle is ``N`` words.  A template of L words is looked for in windows of
L + max(1, L // 4) words, with steps small enough that every run of L words lies
whole in a window.  A window that holds ``CONTAINED`` of the template's shingles
has at least the Jaccard similarity j that follows from these lengths; bands of
``ROWS`` MinHashes, as many as needed, find it with a chance of at least
``CHANCE``: 1 - (1 - j ** ROWS) ** bands.  Every pair found is checked exactly.
Windows without any shingle of a template cannot pass the check and are not hashed.

Overlapping windows of one template and text are one match, from its first shingle
in them to its last.  Null and empty texts, texts shorter than a shingle, and an
empty table give no rows; repeated rows give each its own.  Templates are a parameter and are broadcast; more
than ``MAX_BYTES`` of them are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import ALNUM, U64, blocks, mix, shingle_hashes, text_buffer, word_hashes, word_spans

N, CONTAINED, ROWS, CHANCE, MAX_BYTES, PART_BYTES = 2, 0.8, 2, 0.999, 16 << 20, 4 << 20

#: Short notices, by the names of their licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _shingles(column, lo: int, hi: int, data, offsets, n: int):
    part = data[offsets[lo]:offsets[hi]]
    starts, ends, first = word_spans(part, offsets[lo:hi + 1] - offsets[lo], ALNUM)
    return shingle_hashes(word_hashes(part, starts, ends), first, n)


class Templates:
    """Templates by window length, with their bands."""

    def __init__(self, templates: dict[str, str], n: int = N, contained: float = CONTAINED, rows: int = ROWS, chance: float = CHANCE):
        if sum(len(t.encode()) for t in templates.values()) > MAX_BYTES:
            raise ValueError(f"templates of more than {MAX_BYTES} bytes")
        self.n, self.rows, self.names = n, rows, list(templates)
        column = pa.array(list(templates.values()), pa.large_string())
        data, offsets = text_buffer(column)
        h, at = _shingles(column, 0, len(self.names), data, offsets, n)
        self.sets = [np.unique(h[at[i]:at[i + 1]]) for i in range(len(self.names))]
        self.need = [int(np.ceil(contained * len(s) - 1e-9)) for s in self.sets]
        self.every = np.unique(h)
        self.hash16 = np.zeros(1 << 16, dtype=bool)
        self.hash16[(self.every >> U64(48)).astype(np.int64)] = True
        self.classes: dict[int, list[int]] = {}
        self.step, self.bands = {}, {}
        for i, s in enumerate(self.sets):
            length = int(at[i + 1] - at[i]) + n - 1  # words
            if len(s):
                width = length + max(1, length // 4) - n + 1  # shingles of a window
                self.classes.setdefault(width, []).append(i)
                self.step[width] = min(self.step.get(width, width), max(1, length // 4) + 1)
                j = self.need[i] / (width + len(s) - self.need[i])
                self.bands[width] = max(self.bands.get(width, 1), int(np.ceil(np.log(1 - chance) / np.log1p(-min(j, 1 - 1e-9) ** rows))))
        self.keys = {w: [self._bands(self.sets[i][None, :], self.bands[w])[0] for i in members] for w, members in self.classes.items()}

    def _bands(self, h: np.ndarray, bands: int, present: np.ndarray | None = None) -> np.ndarray:
        """Band keys of each row's shingles."""
        out = np.zeros((len(h), bands), dtype=np.uint64)
        for b in range(bands):
            for r in range(self.rows):
                x = mix(h ^ mix(U64(1 + b * self.rows + r) * np.ones(1, np.uint64)))
                if present is not None:
                    x = np.where(present, x, ~U64(0))
                out[:, b] = mix(out[:, b] + x.min(axis=1))
        return out

    def near(self, h: np.ndarray) -> np.ndarray:
        """Places of shingles that some template has."""
        maybe = np.flatnonzero(self.hash16[(h >> U64(48)).astype(np.int64)])
        return maybe[np.isin(h[maybe], self.every)]

    def scan(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """Matches: row, template, first shingle, end, containment."""
        found = []
        place = self.near(h)
        row = np.searchsorted(at, place, "right") - 1
        local = place - at[row]
        for width, members in self.classes.items():
            step = self.step[width]
            back = np.arange(width // step + 1)
            first = (local // step)[:, None] - back
            ok = (first >= 0) & (first * step + width > local[:, None])
            windows = np.unique(np.stack((np.broadcast_to(row[:, None], first.shape)[ok], first[ok] * step), 1), axis=0)
            for i in range(0, len(windows), 20_000):
                w = windows[i:i + 20_000]
                begin = at[w[:, 0]] + w[:, 1]
                end = np.minimum(begin + width, at[w[:, 0] + 1])
                index = begin[:, None] + np.arange(width)
                present = index < end[:, None]
                x = h[np.minimum(index, len(h) - 1)]
                keys = self._bands(x, self.bands[width], present)
                for t, own in zip(members, self.keys[width], strict=True):
                    for k in np.flatnonzero((keys == own).any(axis=1)).tolist():
                        inside = np.flatnonzero(present[k] & np.isin(x[k], self.sets[t]))
                        held = len(np.unique(x[k][inside]))
                        if held >= self.need[t]:
                            r, s = int(w[k, 0]), int(w[k, 1])
                            found.append((r, t, s, s + width, s + int(inside[0]), s + int(inside[-1]) + self.n, held / len(self.sets[t])))
        out: list[list] = []
        for r, t, s, e, a, b, c in sorted(found):
            if out and out[-1][:2] == [r, t] and s < out[-1][5]:
                out[-1][2:] = [min(out[-1][2], a), max(out[-1][3], b), max(out[-1][4], c), e]
            else:
                out.append([r, t, a, b, c, e])
        return [tuple(x[:5]) for x in out]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row a match: doc_id, license, start_word, end_word, containment."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, **settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            ids, rows = b.column(0), []
            data, offsets = text_buffer(b.column(1))
            for i, j in blocks(offsets, PART_BYTES):
                h, at = _shingles(b.column(1), i, j, data, offsets, t.n)
                rows += [(ids[i + r].as_py(), t.names[k], s, e, c) for r, k, s, e, c in t.scan(h, at)]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)],
                                             names=["doc_id", "license", "start_word", "end_word", "containment"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, license string, start_word long, end_word long, containment double"))
