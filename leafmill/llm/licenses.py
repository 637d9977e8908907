"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text that have a word. Sparse features are hashes of their word 1- and 2-grams
(A-Z folded). A multinomial logistic regression over license families and `unknown` is trained on
variants of the templates (words dropped, put before and behind, names and years filled in) against
paragraphs without a license cue word of at most `train_chars` characters, at most `sample` of them, of about four
times as many documents, all drawn by hashes: the stated bounds of the training set, and of nothing else. A temperature fitted on other variants calibrates its probabilities.

Notices are found by the 3-token runs of the templates (tokens have no punctuation) in the whole text, so also inside a long line
or over line ends: a span that holds `contained` of a template's runs and the family's marks (version, BY, NC, SA, ND) is one; of
overlapping spans the closest to its template counts; the classifier must give it `least` of not being unknown. Any
other paragraph whose best family is not unknown, with a probability of `least` or more, is a notice if its own runs lie
as much within the closest template and it has the marks; else the prediction is not confirmed. `n_reserved` counts `All rights reserved.`,
which grants nothing and so is no family of `families`; the first BSD paragraph is `bsd` unless the document tells which.

Defined results: null or empty texts have no paragraphs; texts of any length are scanned whole, paragraph by
paragraph; repeated rows and paragraphs count as often as they occur; ties go to the first family by
name; extra columns are not returned; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Words, apart, flat, rolling_in_rows, slices

#: The family of a notice that grants nothing; it is counted apart from licenses.
RESERVED = "all-rights-reserved"
#: Longer notices of public licenses, by family.
_NOTICES = {
    "agpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    RESERVED: ("All rights reserved.",),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-3-clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "cc0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0.",),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Names with the version, or where it goes, of the families that short notices name.
_NAMES = {
    "agpl-3.0": ("GNU Affero General Public License", "3"), "apache-2.0": ("Apache License", "2.0"), "bsd-2-clause": ("BSD 2-Clause License", ""), "bsd-3-clause": ("BSD 3-Clause License", ""), "cc0-1.0": ("CC0", "1.0"),
    "gpl-2.0": ("GNU General Public License", "2"), "gpl-3.0": ("GNU General Public License", "3"), "isc": ("ISC License", ""), "lgpl-2.1": ("GNU Lesser General Public License", "2.1"), "lgpl-3.0": ("GNU Lesser General Public License", "3"),
    "mit": ("MIT License", ""), "mpl-2.0": ("Mozilla Public License", "2.0"),
}
_CC = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
_CC_KINDS = ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")


def _templates() -> dict[str, tuple[str, ...]]:
    out = {k: list(v) for k, v in _NOTICES.items()}
    for family, (name, version) in _NAMES.items():
        forms = (f", version {version}", f" version {version}", f" v{version}", f" {version}") if version else ("",)
        start = ("Released under the",) if family == "mit" else ("Licensed under the", "This work is licensed under the")
        out.setdefault(family, []).extend(f"{a} {name}{b}." for a in start for b in forms)
    for kind in _CC_KINDS:
        name = "-".join(_CC[x] for x in kind.split("-"))
        out[f"cc-{kind}-4.0"] = [f"Licensed under CC {kind.upper()} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License."]
    return {k: tuple(v) for k, v in out.items()}


#: What a notice of a family must have besides the template's runs, on its tokens joined by blanks.
_GNU_VERSION = r"(?=.*\b(?:version |v ?|license ){}\b(?! \d\b))"
MARKS = {
    "agpl-3.0": r"(?=.*\bgnu affero general public\b)" + _GNU_VERSION.format("3(?: 0)?"),
    RESERVED: r"(?=.*\ball rights reserved\b)",
    "apache-2.0": r"(?=.*\bapache license (?:version |v ?)?2(?: 0)?\b(?! [1-9]\b))",
    "bsd": r"(?=.*\bsource and binary forms\b)",
    "bsd-2-clause": r"(?=.*\bbsd 2 clause\b)",
    "bsd-3-clause": r"(?=.*\b(?:bsd 3 clause|neither the name)\b)",
    "cc0-1.0": r"(?=.*\bcc0\b)",
    "gpl-2.0": r"(?=.*\bgnu general public\b)" + _GNU_VERSION.format("2(?: 0)?"),
    "gpl-3.0": r"(?=.*\bgnu general public\b)" + _GNU_VERSION.format("3(?: 0)?"),
    "isc": r"(?=.*\b(?:permission to use copy|isc license)\b)",
    "lgpl-2.1": r"(?=.*\bgnu lesser general public\b)" + _GNU_VERSION.format("2 1"),
    "lgpl-3.0": r"(?=.*\bgnu lesser general public\b)" + _GNU_VERSION.format("3(?: 0)?"),
    "mit": r"(?=.*\b(?:mit license|permission is hereby granted free of charge)\b)",
    "mpl-2.0": r"(?=.*\bmozilla public license (?:version |v ?)?2(?: 0)?\b(?! [1-9]\b))",
    "unlicense": r"(?=.*\bfree and unencumbered software\b)",
} | {f"cc-{k}-4.0": rf"(?=.*\b(?:cc {k.replace('-', ' ')}|attribution{''.join(' ' + _CC[x].lower() for x in k.split('-')[1:])}) (?:version |v ?)?4(?: 0)?\b)" for k in _CC_KINDS}
MARKS = {k: re.compile(v, re.S) for k, v in MARKS.items()}
TEMPLATES = _templates()
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
DIMS = 1 << 14


@dataclass
class Scanner:
    weights: np.ndarray  # DIMS + 1 rows (the last is the bias), a column for each family and unknown
    temperature: float


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of some rows, and the row of each line."""
    cut = np.flatnonzero(data == 10) + 1
    edges = np.union1d(cut, offsets)
    row = np.searchsorted(offsets, edges[:-1], "right") - 1
    return edges, row


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature places and line of every word 1- and 2-gram."""
    h = w.hashes(lower=True)
    two, at = rolling_in_rows(h, w.bounds, 2)
    place = np.concatenate([h, two]) >> np.uint64(50)
    line = np.searchsorted(w.bounds, np.concatenate([np.arange(len(h)), at]), "right") - 1
    return place.astype(np.int64), line


def probabilities(model: Scanner, w: Words) -> np.ndarray:
    """Calibrated probabilities of every line; a line is the mean of its grams."""
    n = len(w.bounds) - 1
    place, line = grams(w)
    count = np.maximum(np.bincount(line, minlength=n), 1)
    z = np.stack([np.bincount(line, weights=model.weights[place, k], minlength=n) for k in range(UNKNOWN + 1)], axis=1) / count[:, None]
    z = (z + model.weights[DIMS]) / model.temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def _words(texts: list[str]) -> Words:
    return Words(*flat(pa.array(texts, pa.string())))


def variants(rng: np.random.Generator, n: int) -> tuple[list[str], list[int]]:
    """Changed copies of the templates."""
    out, y = [], []
    extra = "copyright (c) 2019 2021 2024 by the authors see file LICENSE for details project code".split()
    for k, name in enumerate(FAMILIES):
        for t in TEMPLATES[name]:
            for _ in range(-(-3 * n // len(TEMPLATES[name]))):  # a family's count, whatever its number of templates
                words = t.split()
                if len(words) > 6:
                    words = [x for x in words if rng.random() > 0.05]
                words = list(rng.choice(extra, rng.integers(0, 6))) + words + list(rng.choice(extra, rng.integers(0, 6)))
                out.append(" ".join(words))
                y.append(k)
    return out, y


def fit(negatives: list[str], seed: int = 0, rounds: int = 60) -> Scanner:
    """Trains by batch gradient steps with momentum, then fits the temperature on fresh variants."""
    rng = np.random.default_rng(seed)
    texts, y = variants(rng, 40)
    cut = len(negatives) * 3 // 4
    texts, y = texts + negatives[:cut], np.array(y + [UNKNOWN] * cut)
    w = _words(texts)
    place, line = grams(w)
    count = np.maximum(np.bincount(line, minlength=len(texts)), 1)
    value = 1.0 / count[line]
    classes = UNKNOWN + 1
    weights, speed = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))
    share = 1.0 / (np.bincount(y, minlength=classes)[y] * classes)  # each class counts alike
    target = np.eye(classes)[y]
    for _ in range(rounds):
        z = np.stack([np.bincount(line, weights=weights[place, k] * value, minlength=len(texts)) for k in range(classes)], axis=1) + weights[DIMS]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * share[:, None]
        step = np.stack([np.bincount(place, weights=g[line, k] * value, minlength=DIMS) for k in range(classes)], axis=1)
        grad = np.vstack([step, g.sum(axis=0)]) + 1e-7 * weights
        speed = 0.9 * speed - 400.0 * grad * np.vstack([np.ones((DIMS, 1)), np.full((1, 1), 0.01)])
        weights += speed
    model = Scanner(weights, 1.0)
    fresh, fy = variants(rng, 10)
    fresh, fy = fresh + negatives[cut:], np.array(fy + [UNKNOWN] * (len(negatives) - cut))
    w = _words(fresh)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 21):
        p = probabilities(Scanner(weights, float(t)), w)
        best = min(best, (float(-np.log(np.maximum(p[np.arange(len(fy)), fy], 1e-12)).mean()), float(t)))
    return Scanner(weights, best[1])


#: Runs are of tokens: letters and digits, and bytes beyond ASCII.
_TOKEN_GAP = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])


def _template_runs(k: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Sorted run hashes with the template of each, the number of runs of each template, and its family."""
    names = [name for name in FAMILIES for _ in TEMPLATES[name]]
    data, offsets = flat(pa.array([t for name in FAMILIES for t in TEMPLATES[name]], pa.string()))
    w = Words(data, offsets, _TOKEN_GAP)
    h, at = rolling_in_rows(w.hashes(lower=True), w.bounds, k)
    pairs = np.unique(np.stack([h, (np.searchsorted(w.bounds, at, "right") - 1).astype(np.uint64)], axis=1), axis=0)
    template = pairs[:, 1].astype(np.int64)
    return pairs[:, 0], template, np.bincount(template, minlength=len(names)), names


@dataclass
class Passage:
    row: int
    start: int  # tokens of the slice
    end: int
    family: str


def passages(w: Words, templates, contained: float, gap: int = 12) -> list[Passage]:
    """Confirmed notices of some rows (w has their tokens), wherever in a row: spans of a template's runs, the closest first.

    A span ends where a template has no run for `gap` tokens. It is confirmed by `contained` of the template's
    runs and the family's marks; of overlapping spans only the closest counts.
    """
    hashes, template, size, names = templates
    h, at = rolling_in_rows(w.hashes(lower=True), w.bounds, 3)
    left = np.searchsorted(hashes, h, "left")
    count = np.searchsorted(hashes, h, "right") - left
    hit = np.flatnonzero(count)
    if not len(hit):
        return []
    n = count[hit]
    which = np.repeat(left[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    t, place, run = template[which], np.repeat(at[hit], n), np.repeat(h[hit], n)
    row = np.searchsorted(w.bounds, place, "right") - 1
    order = np.lexsort((place, row, t))
    t, place, run, row = t[order], place[order], run[order], row[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (row[1:] != row[:-1]) | (place[1:] - place[:-1] > gap)
    # A repeated notice without a gap: a run that the span already has, of a template already complete, starts anew.
    edges = np.append(np.flatnonzero(new), len(t)).tolist()
    found = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        k = int(t[a])
        seen: set[int] = set()
        start = a
        for x in range(a, b + 1):
            if x == b or int(run[x]) in seen:
                share = len(seen) / int(size[k])
                if share >= contained:
                    found.append((-share, -len(seen), int(row[a]), int(place[start]), int(place[x - 1]) + 3, names[k]))
                if x == b:
                    break
                seen, start = set(), x
            seen.add(int(run[x]))
    taken: dict[int, list[Passage]] = {}
    for _, _, r, start, end, family in sorted(found):
        if all(p.end <= start or end <= p.start for p in taken.get(r, ())):
            words = " ".join(w.data[w.starts[i] : w.ends[i]].tobytes().decode("utf-8", "replace").lower() for i in range(start, min(end + 2, int(w.bounds[r + 1]))))
            if MARKS[family].match(words):
                taken.setdefault(r, []).append(Passage(r, start, end, family))
    return sorted((p for x in taken.values() for p in x), key=lambda p: (p.row, p.start))


def _confirmed(w: Words, templates, contained: float) -> str | None:
    """Family of the closest template whose runs hold as much of one line's runs (or the other way round), with its marks."""
    hashes, template, size, names = templates
    mine = np.unique(rolling_in_rows(w.hashes(lower=True), w.bounds, 3)[0])
    shared = np.bincount(template[np.isin(hashes, mine)], minlength=len(size))
    share = shared / np.maximum(1, np.minimum(len(mine), size))
    words = " ".join(w.data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(w.starts, w.ends, strict=True))
    best = [names[k] for k in np.flatnonzero((share >= contained) & (share == share.max())).tolist()] if len(mine) else []
    return next((f for f in best if MARKS[f].match(words)), None)


def _scan(known, least: float, contained: float):
    def run(batches):
        model, templates = known.value, _template_runs()
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                base = offsets[i]
                part, at = data[base : offsets[j]], offsets[i : j + 1] - base
                edges, row = lines_of(part, at) if len(part) else (np.zeros(1, np.int64), np.zeros(0, np.int64))
                w = Words(part, edges)
                filled = np.diff(w.bounds) > 0
                paragraphs = np.bincount(row[filled], minlength=j - i)
                hits: list[list[tuple[str, float]]] = [[] for _ in range(j - i)]
                unsure = np.zeros(j - i, np.int64)
                if filled.any():
                    # Notices by their runs, in lines of any length and over line ends; then lines by the classifier alone.
                    tokens = Words(part, at, _TOKEN_GAP)
                    spans = passages(tokens, templates, contained)
                    covered = np.zeros(len(row), bool)
                    if spans:
                        texts = [part[tokens.starts[x.start] : tokens.ends[x.end - 1]] for x in spans]
                        p = probabilities(model, Words(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])))
                        for x, q in zip(spans, p, strict=True):
                            first, last = np.searchsorted(edges, [tokens.starts[x.start], tokens.starts[x.end - 1]], "right") - 1
                            covered[first : last + 1] = True
                            if 1 - q[UNKNOWN] >= least:
                                hits[x.row].append((x.family, float(1 - q[UNKNOWN])))
                            else:
                                unsure[x.row] += 1
                    p = probabilities(model, w)
                    family = p.argmax(axis=1)
                    for n in np.flatnonzero(filled & ~covered & (family != UNKNOWN) & (p.max(axis=1) >= least)).tolist():
                        h = w.data[edges[n] : edges[n + 1]]
                        k = _confirmed(Words(h, np.array([0, len(h)]), _TOKEN_GAP), templates, contained)
                        if k:
                            hits[row[n]].append((k, float(1 - p[n, UNKNOWN])))
                        else:
                            unsure[row[n]] += 1
                for x in hits:  # the conditions of both BSD licenses begin alike; the third clause tells
                    if any(f == "bsd-3-clause" for f, _ in x):
                        x[:] = [("bsd-3-clause" if f == "bsd" else f, s) for f, s in x]
                    elif any(f == "bsd-2-clause" for f, _ in x):
                        x[:] = [("bsd-2-clause" if f == "bsd" else f, s) for f, s in x]
                licenses = [[f for f, _ in x if f != RESERVED] for x in hits]
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(i, j - i), "n_paragraphs": pa.array(paragraphs.astype(np.int64)), "n_licenses": pa.array([len(x) for x in licenses], pa.int64()),
                    "n_reserved": pa.array([len(x) - len(y) for x, y in zip(hits, licenses, strict=True)], pa.int64()), "n_unconfirmed": pa.array(unsure),
                    "families": pa.array([",".join(sorted(set(x))) for x in licenses], pa.string()), "score": pa.array([max((s for _, s in x), default=0.0) for x in hits], pa.float64()),
                })

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, train_chars: int = 2000, least: float = 0.5, contained: float = 0.6) -> DataFrame:
    """(doc_id, n_paragraphs, n_licenses, n_reserved, n_unconfirmed, families, score) for every row."""
    rows = apart(docs, doc_id=id_col, text=text_col)[0].select("doc_id", "text")
    text = F.col("text")
    cues = "|".join(("licen[sc]e", "copyright", "redistribut", "permission", "public domain", "rights reserved", "creative commons"))
    # Documents are drawn by a hash first, about `sample` times four, so that only their lines are cut and looked at.
    total = rows.count()
    share = min(1.0, 4.0 * sample / max(1, total))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("license"), "doc_id", "text"), F.lit(1 << 40)) <= F.lit(int(share * (1 << 40))))
    lines = drawn.select(F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line"))
    lines = lines.filter(F.col("line").rlike(WORD) & (F.length("line") <= train_chars) & ~F.lower("line").rlike(cues)).withColumn("h", F.xxhash64(F.lit("license"), "line"))
    lines = lines.orderBy("h", "line").select("line").limit(sample)
    model = fit(sorted(r.line for r in lines.collect()))
    known = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scan(known, least, contained), "doc_id long, n_paragraphs long, n_licenses long, n_reserved long, n_unconfirmed long, families string, score double")
