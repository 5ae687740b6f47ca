"""Licence notices by a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line; a long one is read in overlapping windows of words, and so are the words around each line break,
so a notice inside a line or wrapped over lines is seen. Features are words and word pairs, hashed; a logistic
regression over families, `none` among them, is trained here: on variations of the templates and on lines of the corpus
that resemble no template. Its probabilities are calibrated by a temperature on examples kept out of training. A
paragraph that is more likely some licence than `none`, but of no family with the least probability, is `unknown`. A
prediction is confirmed if a stretch of the words in and around it has enough of the word pairs of a template of its
family. Stretches do not overlap, the likest come first, so each of several notices of a text is a row; its start, end
and line are those of the stretch. Predictions that no stretch touches are unconfirmed rows, overlapping ones of a
family a single row.

The lines for training are a sample of about `negatives` (by a hash), everything else reads all rows and whole texts.
Null or empty texts have no paragraphs. Ties: the first family in order. Repeated rows each give their rows, a null id is passed on.
Very long texts are steps of their own. An empty table has no rows, and the model then learns from the templates alone. Other
columns are ignored. Result: a row per notice.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.words import ALNUM, Words, grams, mix, slices, words_of

# How the notices of common licences begin
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
    ],
}
NONE, UNKNOWN = "none", "unknown"
FAMILIES = [*sorted(TEMPLATES), NONE]
BITS = 14
LONG, WINDOW, STRIDE = 24, 16, 8  # words: longer lines are read in windows, so far apart


class Parts(NamedTuple):
    """Paragraphs of some texts: text, first and end word."""

    text: np.ndarray
    first: np.ndarray
    end: np.ndarray


def windows(first: np.ndarray, size: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of words with more than `longer` in windows, others whole: number of the run, first and end word."""
    pieces = np.where(size > longer, -(-np.maximum(size - WINDOW, 0) // STRIDE) + 1, 1)
    which = np.repeat(np.arange(len(first)), pieces)
    step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, end = first[which] + step * STRIDE, (first + size)[which]
    return which, begin, np.where(size[which] > longer, np.minimum(begin + WINDOW, end), end)


def paragraphs(data: np.ndarray, bounds: np.ndarray, words: Words) -> Parts:
    """Lines, in windows if they are long, and windows that reach over line breaks."""
    above = np.searchsorted(np.flatnonzero(data == 10), words.starts)
    text = np.searchsorted(bounds, words.starts, "right") - 1
    new = np.append(True, (above[1:] != above[:-1]) | (text[1:] != text[:-1]))[: len(above)]
    first = np.flatnonzero(new)
    _, begin, end = windows(first, np.diff(np.append(first, len(above))), LONG)
    some = np.flatnonzero(np.diff(words.first) > 0)
    _, a, b = windows(words.first[some], np.diff(words.first)[some], WINDOW)
    over = above[a] != above[b - 1]
    begin, end = np.append(begin, a[over]), np.append(end, b[over])
    return Parts(text[begin], begin, end)


def slots(words: Words) -> np.ndarray:
    """Hashed features that begin at each word: the word, and the pair with the next one."""
    one = mix(words.hashes)
    two = np.append(grams(words.hashes, 2, 60), one[:1])[: len(one)]
    return (np.stack([one, two], axis=1) >> np.uint64(64 - BITS)).astype(np.int64)


def logits(weights: np.ndarray, bias: np.ndarray, active: np.ndarray, parts: Parts) -> np.ndarray:
    total = [np.concatenate([np.zeros((1, len(bias))), np.cumsum(weights[active[:, k]], axis=0)]) for k in (0, 1)]
    n = parts.end - parts.first
    summed = total[0][parts.end] - total[0][parts.first] + total[1][parts.end - 1] - total[1][parts.first]
    return summed / np.sqrt(np.maximum(2 * n - 1, 1))[:, None] + bias


class Model(NamedTuple):
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float  # probability a family needs


def word_pairs(words: Words, a: int, b: int) -> set[int]:
    own = words.hashes[a:b]
    return set(grams(own, 2).tolist()) or set(own.tolist())


def template_pairs() -> dict[str, list[set[int]]]:
    out = {}
    for family, texts in TEMPLATES.items():
        for part in slices(pa.array(texts)):
            words = words_of(part, ALNUM)
            out[family] = [word_pairs(words, words.first[i], words.first[i + 1]) for i in range(len(texts))]
    return out


def likeness(pairs: set[int], templates: list[set[int]]) -> tuple[float, int]:
    """The largest share of a template's pairs that is among `pairs`, and which template it is."""
    shares = [len(pairs & t) / len(t) for t in templates]
    best = int(np.argmax(shares))
    return shares[best], best


def variations(seed: int, each: int, noise: list[str]) -> tuple[list[str], list[int]]:
    """Templates with words left out and ordinary words around them."""
    draw, texts, target = random.Random(seed), [], []
    for family, templates in TEMPLATES.items():
        for k in range(each):
            own = templates[k % len(templates)].split(" ")
            kept = [w for w in own if k < len(templates) or draw.random() > 0.1] or own
            before, after = ([draw.choice(noise) for _ in range(draw.randrange(9))] if noise and k >= len(templates) else [] for _ in range(2))
            texts.append(" ".join([*before, *kept, *after]))
            target.append(FAMILIES.index(family))
    return texts, target


def whole(texts: list[str]) -> tuple[Words, Parts]:
    """Words of texts that fit one step, each a paragraph."""
    [part] = slices(pa.array(texts, pa.string()), 1 << 40)
    words = words_of(part, ALNUM)
    n = np.arange(len(texts))
    a, b = words.first[:-1], words.first[1:]
    return words, Parts(n, a, b)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(lines: list[str], rounds: int = 200, rate: float = 2.0, least: float = 0.5, seed: int = 0) -> Model:
    """Learns from the templates and from ordinary lines."""
    templates = template_pairs()
    lines = sorted({x for x in lines if any(c.isalnum() for c in x)})
    if lines:
        words, parts = whole(lines)
        plain = [
            all(likeness(word_pairs(words, a, b), t)[0] < 0.5 for t in templates.values())
            for a, b in zip(parts.first.tolist(), parts.end.tolist(), strict=True)
            if b > a
        ]
        lines = [x for x, p in zip([x for x, a, b in zip(lines, parts.first, parts.end, strict=True) if b > a], plain, strict=True) if p]
    noise = sorted({w for x in lines[:500] for w in x.split()[:20]})
    texts, target = variations(seed, 60, noise)
    order = list(range(len(texts) + len(lines)))
    random.Random(seed).shuffle(order)
    texts, target = texts + lines, np.array(target + [FAMILIES.index(NONE)] * len(lines))
    words, parts = whole(texts)
    active = slots(words)
    train, held = np.array(order[len(order) // 5 :]), np.array(order[: len(order) // 5])
    weights, bias = np.zeros((1 << BITS, len(FAMILIES))), np.zeros(len(FAMILIES))
    pick = lambda rows: Parts(*[p[rows] for p in parts])
    own = pick(train)
    size = own.end - own.first
    row = np.repeat(np.arange(len(train)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + own.first[row]
    pair = place + 1 < own.end[row]
    feature, owner = np.concatenate([active[place, 0], active[place[pair], 1]]), np.concatenate([row, row[pair]])
    scale = 1 / np.sqrt(np.maximum(2 * size - 1, 1))
    wanted = np.eye(len(FAMILIES))[target[train]]
    share = wanted.sum(axis=0)
    balance = (1 / np.maximum(share, 1))[target[train]][:, None] * len(train) / len(FAMILIES)
    by = np.argsort(feature, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(feature[by]) != 0))
    for _ in range(rounds):
        gap = (softmax(logits(weights, bias, active, own)) - wanted) * balance / len(train)
        step = np.add.reduceat((gap * scale[:, None])[owner[by]], first)
        weights[feature[by][first]] -= rate * (step * 50 + 1e-4 * weights[feature[by][first]])
        bias -= rate * gap.sum(axis=0)
    scores = logits(weights, bias, active, pick(held))
    loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(held)), target[held]] + 1e-12).mean()
    return Model(weights.astype(np.float32), bias, float(min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)), least)


def predict(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the family of each paragraph (len(FAMILIES): unknown) and its probability."""
    p = softmax(scores / model.temperature)
    none = FAMILIES.index(NONE)
    best = p[:, :none].argmax(axis=1)
    chance = p[np.arange(len(p)), best]
    licence = p[:, none] < 0.5
    return np.where(licence, np.where(chance >= model.least, best, len(FAMILIES)), none), np.where(licence, chance, p[:, none])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Stretch(NamedTuple):
    share: float
    first: int
    end: int
    family: str
    which: int


def stretches(pairs: list[int], looks: dict[str, list[tuple[int, int]]], templates: dict[str, list[set[int]]], enough: float) -> list[Stretch]:
    """Stretches of words that do not overlap, with enough of a template's pairs, the likest first; `looks`: where to look for each family."""
    found: list[Stretch] = []
    while looks:
        here: list[tuple[tuple, Stretch]] = []
        for family, ranges in looks.items():
            for which, own in enumerate(templates[family]):
                for a, b in ranges:
                    at = [i for i in range(a, b - 1) if pairs[i] in own]
                    for j, i in enumerate(at):
                        seen: set[int] = set()
                        last = i
                        for m in range(j, len(at)):
                            k = at[m]
                            if k >= i + len(own) + 2 * WINDOW or len(seen) == len(own):
                                break
                            if pairs[k] not in seen:
                                seen.add(pairs[k])
                                last = k
                        if len(seen) >= enough * len(own):
                            s = Stretch(len(seen) / len(own), i, last + 2, family, which)
                            here.append(((-s.share, -len(own), s.end - s.first, s.first, family, which), s))
        taken: set[int] = set()
        for _, s in sorted(here):
            if taken.isdisjoint(range(s.first, s.end)):
                taken.update(range(s.first, s.end))
                found.append(s)
        # what lies between them is looked at again without them
        cut = merged([(s.first, s.end) for s in found])
        looks = {f: left for f, ranges in looks.items() if taken and (left := [x for r in ranges for x in without(r, cut)])}
    return found


def without(of: tuple[int, int], cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a range, two words at least."""
    out, (a, b) = [], of
    for x, y in cut[max(0, bisect.bisect(cut, (a, a)) - 1) :]:
        if x >= b:
            break
        if y > a:
            out.append((a, x))
            a = y
    return [(x, y) for x, y in [*out, (a, b)] if y - x > 1]


COLUMNS = [
    ("line", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()),
    ("template", pa.string()), ("similarity", pa.float64()), ("confirmed", pa.bool_()),
]


def notices(pairs: list[int], low: int, high: int, seen: list[tuple[int, int, str, float]], templates: dict, enough: float) -> Iterator[dict]:
    """Rows of a text with the words low to high, from its predictions (first, end, family, probability)."""
    wide = lambda a, b: (max(a - WINDOW, low), min(b + WINDOW, high))  # noqa: E731  a long notice reaches over its window
    families = sorted({f for _, _, f, _ in seen})
    found = stretches(pairs, {f: merged([wide(a, b) for a, b, g, _ in seen if g == f]) for f in families if f in templates}, templates, enough)
    by = {f: sorted((*wide(a, b), p) for a, b, g, p in seen if g == f) for f in families}
    for s in found:
        near = by[s.family]
        near = near[bisect.bisect(near, (s.first - 2 * WINDOW - LONG,)) : bisect.bisect(near, (s.end,))]
        chance = max(p for a, b, p in near if b > s.first)
        yield dict(first=s.first, last=s.end, family=s.family, probability=chance, template=TEMPLATES[s.family][s.which], similarity=s.share, confirmed=True)
    cut = merged([(s.first, s.end) for s in found])
    touched = lambda a, b: any(y > a for x, y in cut[max(0, bisect.bisect(cut, (a, a)) - 1) : bisect.bisect(cut, (b,))])
    for family in families:
        rest = sorted((a, b, p) for a, b, g, p in seen if g == family and not touched(a, b))
        k = 0
        for a, b in merged([(a, b) for a, b, _ in rest]):
            chance = 0.0
            while k < len(rest) and rest[k][0] < b:
                chance, k = max(chance, rest[k][2]), k + 1
            i, j = wide(a, b)
            own = set(pairs[i : j - 1])
            share, which, of = max(((*likeness(own, templates[f]), f) for f in ([family] if family in templates else sorted(templates))), key=lambda x: x[0])
            template = TEMPLATES[of][which] if share > 0 else None
            yield dict(first=a, last=b, family=family, probability=chance, template=template, similarity=share, confirmed=False)


def _scan(model: Model, enough: float):
    none = FAMILIES.index(NONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = template_pairs()
        for batch in batches:
            for texts in slices(batch.column("text")):
                words = words_of(texts, ALNUM)
                found: list[dict] = []
                if len(words.hashes):
                    parts = paragraphs(texts.data, texts.bounds, words)
                    family, chance = predict(model, logits(model.weights, model.bias, slots(words), parts))
                    seen: dict[int, list] = {}
                    for k in np.flatnonzero(family != none).tolist():
                        name = (*FAMILIES, UNKNOWN)[family[k]]
                        seen.setdefault(int(parts.text[k]), []).append((int(parts.first[k]), int(parts.end[k]), name, float(chance[k])))
                    two = grams(words.hashes, 2)
                    for text, own in seen.items():
                        zero, low, high = (int(x[text]) for x in (texts.bounds, words.first, words.first[1:]))
                        pairs, at, chars, lines = two[low : high - 1].tolist(), zero, 0, 0
                        place = {}  # of byte offsets: code points and line breaks before them
                        rows = list(notices(pairs, 0, high - low, [(a - low, b - low, f, p) for a, b, f, p in own], templates, enough))
                        for r in rows:
                            r["first"], r["last"] = int(words.starts[low + r["first"]]), int(words.ends[low + r["last"] - 1])
                        for x in sorted({r[c] for r in rows for c in ("first", "last")}):
                            piece = texts.data[at:x]
                            chars, lines, at = chars + int(((piece & 0xC0) != 0x80).sum()), lines + int((piece == 10).sum()), x
                            place[x] = chars, lines
                        for r in sorted(rows, key=lambda r: (r["first"], r["last"], r["family"])):
                            (start, line), (end, _) = place[r["first"]], place[r["last"]]
                            found.append({**r, "row": texts.rows.start + text, "line": line, "start": start, "end": end})
                ids = batch.column("doc_id").take(pa.array([r["row"] for r in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in found], t) for c, t in COLUMNS]], ["doc_id", *[c for c, _ in COLUMNS]])

    return run


def train(docs: DataFrame, negatives: int = 4000) -> Model:
    """A model from about `negatives` lines of the corpus (of at most 60 words each) and the templates.

    Texts are chosen by their hash, of each the four lines with the smallest hashes, and of all these at most 2 * `negatives`,
    again by hash: the same rows give the same model, however they are dealt over files and tasks."""
    ids = docs.where("text is not null").select(F.xxhash64("text").alias("key"), "text")
    total = docs.count()
    texts = ids.where(F.pmod("key", F.lit(1 << 30)) < int(min(1.0, negatives / 4 / max(total, 1)) * (1 << 30)))
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.xxhash64("key", i).alias("h"), i.alias("i"), x.alias("x")))
    lines = texts.select(F.inline(F.slice(F.array_sort(marked), F.lit(1), F.lit(4)))).orderBy("h", "i", "x").limit(2 * negatives)
    lines = lines.select(F.array_join(F.slice(F.split("x", " "), F.lit(1), F.lit(60)), " ").alias("x"))
    return fit([r["x"] for r in lines.collect()])


def find_licences(docs: DataFrame, model: Model, enough: float = 0.6) -> DataFrame:
    """doc_id, line, start, end (code points), family, probability, template, similarity, confirmed."""
    docs = docs.select("doc_id", "text")
    types = "line long, start long, end long, family string, probability double, template string, similarity double, confirmed boolean"
    return docs.mapInArrow(_scan(model, enough), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {types}")
