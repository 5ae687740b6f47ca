"""Language identification by the nearest of several centroids per language.

A text is the vector of its letter n-grams (one to three letters, word borders included, hashed), weighted by
sublinear counts and inverse document frequency and normalised. Fitting clusters a bounded sample of each language into
a few centroids; a text gets the language of the centroid with the largest cosine. Distance rejects: each language has a
bound for each class of length, from the cosines of its sampled texts of that length (longer ones cut to it where few
are), each taken against centroids of the half of the sample that it is not in: three times as far below their median as
their 5 % quantile is, and not below the bound of shorter texts. A text below the bound of its language is rejected.

The sample: about `per_language` labelled rows of each language (binomial, by a hash of the id), so what one clustering
task holds is bounded. Document frequencies and everything else are of all rows and whole texts.

Null text or text without a letter: `und`, score 0, rejected. Null id: never used to fit. Null labels are not learned.
No labelled row: every prediction is `und`. An empty table has no rows. Ties: the first language in order. Very long texts are whole
vectors, one step of a task. Repeated rows each get their row.
Other columns are ignored (`keep_accepted` hands them on).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.base import frugal, remainder, written
from seqdrift.llm.words import mix, slices, stream

BITS = 12
WIDTH = 1 << BITS
N = (1, 2, 3)
ROWS = 256  # texts whose dense vectors are in memory at once
MANY = 200  # texts of a length that are enough for its bound
LENGTHS = 32  # classes of text length, by powers of two


@functools.cache
def _letters() -> np.ndarray:
    """Of every code point: its own number if it is a letter, else 0."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[[not chr(i).isalpha() for i in range(0x110000)]] = 0
    return table


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (a row per text) and letters of each text."""
    coded = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in coded])
    x = _letters()[np.concatenate([np.append(c, np.uint32(0)) for c in coded])] if coded else np.zeros(0, np.uint32)
    letters = np.bincount(owner[x > 0], minlength=len(texts))
    stay = (x > 0) | np.append(True, x[:-1] > 0)  # a run of other characters is one border
    x, owner = x[stay].astype(np.uint64), owner[stay]
    x = np.append(np.uint64(0), x)
    out = np.zeros(len(texts) * WIDTH, np.int64)
    for n in N:
        h = np.zeros(max(0, len(x) - n + 1), np.uint64)
        for j, weight in enumerate(stream(20 + n, n)):
            h += x[j : j + len(h)] * weight
        last = x[n - 1 :] > 0  # grams end with a letter, so the border between two texts belongs to the later one
        slot = (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)[last]
        out += np.bincount(owner[n - 2 :][last] * WIDTH + slot, minlength=len(out)) if n > 1 else np.bincount(owner[last[1:]] * WIDTH + slot, minlength=len(out))
    return out.reshape(len(texts), WIDTH), letters


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(found.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), LENGTHS - 1)


def cluster(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k centroids of unit vectors by cosine; the first is the mean, each next one starts at the farthest vector."""
    centroids = v.mean(axis=0, keepdims=True)
    centroids /= max(np.linalg.norm(centroids), 1e-12)
    while len(centroids) < min(k, len(v)):
        centroids = np.vstack([centroids, v[(v @ centroids.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        near = (v @ centroids.T).argmax(axis=1)
        sums = np.stack([v[near == c].sum(axis=0) if (near == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # the number of the language of each centroid
    least: np.ndarray  # by language and length class: a smaller cosine rejects


@frugal
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for part in slices(batch.column("text"), rows=ROWS):
            found, _ = counts(batch.column("text")[part.rows].to_pylist())
            total += (found > 0).sum(axis=0)
            n += len(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(WIDTH), -1)), pa.array(np.append(total, n))], ["slot", "n"])


def bounds(texts: list[str], v: np.ndarray, size: np.ndarray, idf: np.ndarray, k: int) -> list[float]:
    """By length class, the cosine that texts of a language hardly go below."""
    halves = [cluster(v[i::2] if len(v) > 1 else v, k) for i in (1, 0)]  # of the texts that are not in the half
    other = lambda x, row: np.where(row % 2 == 0, *[(x @ c.T).max(axis=1) for c in halves])
    near = other(v, np.arange(len(v)))
    out: list[float] = []
    for c in range(LENGTHS):
        own = near[size == c]
        longer = np.flatnonzero(size > c)[: MANY - len(own)] if len(own) < MANY else []
        if len(longer):  # parts with between 2^c and 2^(c+1) letters
            parts = ["".join(_until(texts[i], (3 << c) // 2)) for i in longer]
            own = np.append(own, other(vectors(counts(parts)[0], idf), longer))
        if len(own):
            low, middle = np.quantile(own, [0.05, 0.5])
            out.append(max(out[-1] if out else 0.0, float(3 * low - 2 * middle)))
        else:  # longer than all: no closer than the longest
            out.append(out[-1] if out else 0.0)
    return out


def _until(text: str, letters: int) -> Iterator[str]:
    """The characters of a text up to so many letters."""
    for x in text:
        yield x
        letters -= x.isalpha()
        if letters <= 0:
            return


def _fit_one(idf: np.ndarray, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        texts = rows["text"].tolist()
        v, letters = [], []
        for i in range(0, len(texts), ROWS):
            found, many = counts(texts[i : i + ROWS])
            v.append(vectors(found, idf))
            letters.append(many)
        v, letters = np.concatenate(v), np.concatenate(letters)
        texts = [t for t, n in zip(texts, letters, strict=True) if n]
        v, letters = v[letters > 0], letters[letters > 0]
        if not len(v):
            return pd.DataFrame({"lang": [], "centroids": [], "least": []})
        centroids = cluster(v, k)
        least = bounds(texts, v, length_class(letters), idf, k)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "centroids": [centroids.astype("<f4").tobytes()], "least": [least]})

    return run


def fit(docs: DataFrame, per_language: int = 2000, clusters: int = 4, max_languages: int = 1000) -> Model:
    """Learns from rows of `docs` (doc_id, text, lang) with a label; the caller leaves out what is held out."""
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} labels: not languages")
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(sizes.items())], F.lit(0.0))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = written(labelled.where(unit < share), "language-sample")
    frequency = labelled.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(WIDTH + 1)
    for r in frequency:
        seen[r["slot"]] = r["n"]
    idf = (np.log((1 + seen[-1]) / (1 + seen[:WIDTH])) + 0.1).astype(np.float32)
    found = sample.groupBy("lang").applyInPandas(_fit_one(idf, clusters), "lang string, centroids binary, least array<double>")
    rows = sorted(found.collect(), key=lambda r: r["lang"])
    least = np.array([r["least"] for r in rows]).reshape(len(rows), LENGTHS)
    centroids = [np.frombuffer(r["centroids"], "<f4").reshape(-1, WIDTH) for r in rows]
    return Model(
        [r["lang"] for r in rows],
        idf,
        np.concatenate(centroids) if rows else np.zeros((0, WIDTH), np.float32),
        np.repeat(np.arange(len(rows)), [len(c) for c in centroids]),
        least,
    )


def classify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is accepted, of each text."""
    found, letters = counts(texts)
    some = letters > 0
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    near = vectors(found, model.idf) @ model.centroids.T
    best = near.argmax(axis=1)
    score = np.where(some, np.clip(near[np.arange(len(texts)), best], 0.0, 1.0), 0.0).astype(np.float64)
    lang = model.owner[best]
    accepted = some & (score >= model.least[lang, length_class(letters)])
    return [model.languages[i] if s else "und" for i, s in zip(lang, some, strict=True)], score, accepted


def _predict(model: Model):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text"), rows=ROWS):
                lang, score, accepted = classify(batch.column("text")[part.rows].to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part.rows], pa.array(lang, pa.string()), pa.array(score), pa.array(~accepted)],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return run


def _accepted(model: Model):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text"), rows=ROWS):
                *_, accepted = classify(batch.column("text")[part.rows].to_pylist(), model)
                yield batch.slice(part.rows.start, len(accepted)).filter(pa.array(accepted))

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected: from the text alone."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_predict(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not rejected."""
    return docs.mapInArrow(_accepted(model), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: the remainder of the id's CRC by 4 is not 2."""
    return docs.where(remainder("doc_id", 4) != 2)
