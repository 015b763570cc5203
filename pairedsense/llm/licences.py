"""Licence scan: a trained paragraph classifier whose finds a template must confirm.

Paragraphs are lines. A multinomial logistic regression over hashed words and
word pairs tells licence families and ``unknown`` apart. It judges windows of
``WINDOW`` words that start every ``STRIDE`` words of a line, so the words
around a notice don't outvote it however long the line is. It is trained here: on
pieces of the templates below, whole and cut, alone and between corpus words,
and on the windows of at most ``MAX_BACKGROUND`` paragraphs of the corpus (those
of the least hash) as unknown. A part of both is held back, and the probability
that a family needs is the least at which at most ``FALSE_SHARE`` of the
held-back unknown windows pass. Every window that passes is compared with the
templates of each family that it may be: it counts only if it shares enough runs of three words with
one of them, and also enough of those runs that tell the family from all others. Near relatives that
are no family here (``RELATED``) are trained as unknown and take part in what tells families apart.
A window may hold several families; a paragraph has a find per family, that of its most probable window.

All windows of all documents are scored, a whole Arrow piece at a time;
only the few that pass are looked at one by one. The weights have a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

DIMENSIONS = 1 << 17
MAX_BACKGROUND = 2000
BACKGROUND_POINTS = 2000
WINDOW, STRIDE = 40, 20
VARIANTS = 45
FALSE_SHARE = 0.002
SHARED = 0.5
POSSIBLE = 0.01  # a family of a lower probability is not compared

# Public notice texts of licence families, one sentence or paragraph each.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."],
}
# Public notices of licences that are near relatives of a family above but not it.
RELATED = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the Educational Community License, Version 2.0.",
    "Licensed under the Boost Software License, Version 1.0.",
    "Released under the Artistic License.",
]
FAMILIES = [*TEMPLATES, "unknown"]
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_PLAIN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_OUT = "n_paragraphs long, finds array<struct<paragraph: long, family: string, probability: double, shared: double>>"


def plain(text: str) -> list[str]:
    return _PLAIN.findall(text.translate(_LOWER))


_LOWER = {i: i + 32 for i in range(65, 91)}


def triples(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


_TRIPLES = {family: [triples(plain(t)) for t in texts] for family, texts in TEMPLATES.items()}


def _own_runs() -> dict[str, list[set]]:
    """Per template, the runs that no other family's and no related notice has."""
    related = set().union(*[triples(plain(t)) for t in RELATED])
    out = {}
    for family, sets in _TRIPLES.items():
        others = related.union(*[t for f, rest in _TRIPLES.items() if f != family for t in rest])
        out[family] = [t - others for t in sets]
    return out


_OWN = _own_runs()
_ORDER = {family: [[*zip(w, w[1:], w[2:])] or [tuple(w)] for w in map(plain, texts)] for family, texts in TEMPLATES.items()}


def shared_with(family: str, text: str) -> float:
    """Largest share of a template's runs of three words that the paragraph holds, or of the paragraph's that a template holds.

    A template counts only if the paragraph holds as large a share of the runs that tell its family from the others;
    where the paragraph is a piece of the template, of those inside the piece, and one at least.
    """
    own = triples(plain(text))
    best = 0.0
    for t, telling, order in zip(_TRIPLES[family], _OWN[family], _ORDER[family]):
        both, told = len(own & t), len(own & telling)
        if told >= SHARED * len(telling):
            best = max(best, both / len(t))
        if told and both >= 3:
            held = [i for i, run in enumerate(order) if run in own]
            inside = telling.intersection(order[held[0] : held[-1] + 1])
            if told >= SHARED * len(inside):
                best = max(best, both / len(own))
    return best


def paragraphs(piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of the lines of all rows, first line of each row and one past the last); a line ends before its \\n."""
    breaks = np.flatnonzero(piece.data == 10) + 1
    bounds = np.unique(np.concatenate([piece.bounds, breaks]))
    # Every row has one line more than it has breaks; a row without text has none in ``bounds``.
    return bounds, np.searchsorted(bounds, piece.bounds)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words and pairs of the lines, bounds of each line's words, starts and ends of the words)."""
    starts, ends, rows = T.segments(_KIND[data], bounds, 0)
    words = T.hash_spans(T.LOWER[data], starts, ends)
    both = np.empty(2 * len(words), dtype=np.uint64)
    both[0::2] = words
    both[1::2] = T.mix(words * T.factor(2) + np.concatenate((words[1:], words[:1])) * T.factor(3)) if len(words) else words
    both = (both % np.uint64(DIMENSIONS)).astype(np.int64)
    last = 2 * rows[1:][rows[1:] > rows[:-1]] - 1  # the pair after a line's last word says nothing
    both[last] = DIMENSIONS
    return both, rows, starts, ends


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, one past the last, line) of the windows; every word is in one, and a short line is one window."""
    n = np.diff(rows)
    many = np.where(n > 0, np.maximum(-(-n // STRIDE) - 1, 1), 0)
    line = np.repeat(np.arange(len(n)), many)
    place = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
    first = rows[:-1][line] + place * STRIDE
    return first, np.minimum(first + WINDOW, rows[1:][line]), line


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, needed: float) -> None:
        self.weights, self.bias, self.needed = weights, bias, needed

    def probabilities(self, found: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each window [first, last) of words, by these words and the pairs between them."""
        z = np.zeros((len(first), len(FAMILIES)))
        if len(first):
            # Every other sum is between two windows.
            z += np.add.reduceat(self.weights[found], np.column_stack((2 * first, 2 * last - 1)).ravel(), axis=0)[::2]
        z += self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _examples(background: list[str], seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Training paragraphs and their classes: pieces of templates, half of them between corpus words, and the corpus paragraphs."""
    rng = np.random.Generator(np.random.PCG64(seed))
    texts, classes = [], []
    spare = [w for line in background for w in line.split()] or ["word"]
    for c, notices in enumerate([*TEMPLATES.values(), RELATED]):  # the related ones are of the last class, unknown
        for template in notices:
            words = template.split()
            for i in range(VARIANTS):
                size = len(words) if i % 3 == 0 else int(rng.integers(max(3, len(words) * 2 // 3), len(words) + 1))
                at = int(rng.integers(0, len(words) - size + 1))
                part = words[at : at + size]
                if i % 2:
                    fill = [spare[j] for j in rng.integers(0, len(spare), int(rng.integers(1, 40)))]
                    cut = int(rng.integers(0, len(fill) + 1))
                    part = fill[:cut] + part + fill[cut:]
                texts.append(" ".join(part))
                classes.append(c)
    return texts + background, np.array(classes + [len(FAMILIES) - 1] * len(background))


def _fit(found: np.ndarray, rows: np.ndarray, classes: np.ndarray, steps: int = 80, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on sparse counts, by adaptive gradient steps over all examples."""
    k, n = len(FAMILIES), len(classes)
    used, where = np.unique(found, return_inverse=True)
    owner = np.repeat(np.arange(n), np.diff(rows))
    real = used[where] < DIMENSIONS
    where, owner = where[real], owner[real]
    order = np.argsort(where, kind="stable")
    sorted_where, sorted_owner = where[order], owner[order]
    firsts = np.flatnonzero(np.concatenate(([True], sorted_where[1:] != sorted_where[:-1])))
    w, b = np.zeros((len(used), k)), np.zeros(k)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    wanted = np.eye(k)[classes]
    share = wanted.sum(axis=0)
    cost = (n / (k * np.maximum(share, 1)))[classes][:, None]
    cuts = np.searchsorted(owner, np.arange(n))
    has = np.flatnonzero(np.diff(np.concatenate((cuts, [len(owner)]))))
    for _ in range(steps):
        z = np.tile(b, (n, 1))
        if len(has):
            z[has] += np.add.reduceat(w[where], cuts[has], axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - wanted) * cost / n
        grad = decay * w
        if len(firsts):
            grad[sorted_where[firsts]] += np.add.reduceat(error[sorted_owner], firsts, axis=0)
        gw += grad**2
        gb += error.sum(axis=0) ** 2
        w -= 0.3 * grad / np.sqrt(gw)
        b -= 0.3 * error.sum(axis=0) / np.sqrt(gb)
    weights = np.zeros((DIMENSIONS + 1, k), dtype=np.float32)
    weights[used[used < DIMENSIONS]] = w[used < DIMENSIONS]
    return weights, b


def train(background: list[str]) -> Model:
    """The model and the probability that a family needs; ``background`` is bounded by the caller."""
    background = [x for x in background if max(shared_with(f, x) for f in TEMPLATES) < SHARED]
    held = cut(background[::4])
    texts, classes = _examples(cut([x for i, x in enumerate(background) if i % 4]))
    found, rows = _of(texts)
    model = Model(*_fit(found, 2 * rows, classes), 0.5)
    if held:
        found, rows = _of(held)
        best = np.sort(1 - model.probabilities(found, *windows(rows)[:2])[:, -1])
        model.needed = max(0.5, float(best[min(len(best) - 1, int(np.ceil(len(best) * (1 - FALSE_SHARE))))]))
    model.needed = min(model.needed, 0.999)
    return model


def _of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8") for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return features(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)[:2]


def cut(lines: list[str]) -> list[str]:
    """The windows of the lines, but for those that a template confirms."""
    raw = [t.encode("utf-8") for t in lines]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    _, rows, starts, ends = features(data, bounds)
    first, last, _ = windows(rows)
    out = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[first], ends[last - 1])]
    return [x for x in out if max(shared_with(f, x) for f in TEMPLATES) < SHARED]


def background_sample(docs: DataFrame, limit: int = MAX_BACKGROUND) -> list[str]:
    """At most ``limit`` distinct paragraphs of 20 code points or more, those with the least hash; of a long one the first ``BACKGROUND_POINTS``."""
    every = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    line = every.filter(F.length("line") >= 20).select(F.substring("line", 1, BACKGROUND_POINTS).alias("line"))
    h = F.xxhash64("line", F.lit("licences"))
    # Only hashes are shuffled, once per task; then the paragraphs up to the limit-th hash are fetched.
    least = line.select(h.alias("h")).distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if least is None:
        return []
    rows = line.filter(h <= least).groupBy(h.alias("h")).agg(F.min("line").alias("line")).orderBy("h").collect()
    return [r["line"] for r in rows]


def _scan(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            counts, finds = [], []
            for piece in T.slices(batch.column(batch.schema.get_field_index("text"))):
                bounds, first = paragraphs(piece)
                found, rows, starts, ends = features(piece.data, bounds)
                begin, end, line_of = windows(rows)
                p = model.probabilities(found, begin, end)
                hit = np.flatnonzero(1 - p[:, -1] >= model.needed)
                confirmed: dict[tuple[int, int], dict] = {}
                for k in hit.tolist():
                    text = piece.data[starts[begin[k]] : ends[end[k] - 1]].tobytes().decode("utf-8", "replace")
                    line = int(line_of[k])
                    for family in np.flatnonzero(p[k, :-1] >= POSSIBLE).tolist():
                        chance, shared = float(p[k, family]), shared_with(FAMILIES[family], text)
                        if shared >= SHARED and ((line, family) not in confirmed or chance > confirmed[line, family]["probability"]):
                            confirmed[line, family] = {"family": FAMILIES[family], "probability": chance, "shared": shared}
                own: list[list[dict]] = [[] for _ in range(len(piece))]
                for (line, _), find in sorted(confirmed.items()):
                    # rows without text share their bound with the next row: the last row that starts there has the line
                    row = int(np.searchsorted(piece.bounds, bounds[line], side="right")) - 1
                    own[row].append({"paragraph": int(line - first[row]), **find})
                breaks = np.concatenate(([0], np.cumsum(piece.data == 10)))
                counts.append(breaks[piece.bounds[1:]] - breaks[piece.bounds[:-1]] + 1)
                finds += own
            kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("shared", pa.float64())]))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), pa.array(finds, kind)], names=[*names, "n_paragraphs", "finds"])

    return run


def find_licences(docs: DataFrame, limit: int = MAX_BACKGROUND) -> DataFrame:
    """(doc_id, n_paragraphs, finds) per row of ``docs`` (doc_id, text, ...).

    A find is (paragraph number from 0, family, probability, share of common runs of three words); a paragraph with notices of several families has several.

    * A null or empty text is one empty paragraph without a find. Rows are scanned on their own, also where doc_ids repeat or are NULL.
    * Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(train(background_sample(docs, limit)))
    return docs.mapInArrow(_scan(sent, docs.columns), f"doc_id long, text string, {_OUT}").drop("text")


def summary(found: DataFrame) -> DataFrame:
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("finds", lambda x: x["family"]))), ",")
    lines = F.size(F.array_distinct(F.transform("finds", lambda x: x["paragraph"]))).cast("long")
    return found.select("doc_id", "n_paragraphs", lines.alias("n_licence_paragraphs"), families.alias("families"))
