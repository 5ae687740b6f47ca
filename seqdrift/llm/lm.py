"""Scores of a hashed maximum-entropy language model, and of a unigram base beside it.

The model factors a token's probability into its class and the token within its class:

* p(class | history) is a softmax over a few classes. Its features are the word before, the two words before together,
  and the word two back alone (skip), hashed into a table of weights; a bias per class is one more row.
* p(token | class) is (c + 1) / Z with c the token's count and Z the sum over the class, unknown tokens counting as one
  more member of the last class. So the probabilities of all tokens add up to one.

Frequent words fill the first classes with equal shares of the text; all others are the last class. The frequent words
are at most `frequent` by a threshold found from a histogram of counts, so tasks hold a table of bounded size; the
other tokens meet their counts in a join.

Training is by gradient updates (AdaGrad over mini-batches) in every part over all its training rows; then each row of
weights is averaged over the parts by how often its feature occurred there, and the next round starts from the average.
Rows are dealt to parts of about 2 million tokens by a hash of id and text, and sorted by it, and the number of parts
follows the number of tokens alone: the same rows give the same scores, however files and tasks cut them.

Null or empty text: the end token alone. Null id: never held out. Repeated rows each get their row. Very long texts are steps of their
own. Ties: words of equal counts are ordered by hash. No training rows: all counts 0, base 0; an empty table has no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.base import remainder, written
from seqdrift.llm.words import NOT_SPACE, Texts, mix, slices, stream, words_of

END, START = mix(np.array([1, 2], np.uint64))  # the end of a text, and what stands before its first word
CLASSES = 16
BITS = 15
BIAS = 1 << BITS  # the row of weights after those of the features
BATCH = 1 << 14
RATE = 0.3
PART_TOKENS, MIN_PARTS = 2_000_000, 8  # of a part of training


class Tokens(NamedTuple):
    hashes: np.ndarray  # words of all texts, an end after those of each
    owner: np.ndarray  # the number of the text of each


def tokens_of(texts: Texts) -> Tokens:
    words = words_of(texts, NOT_SPACE)
    n = len(words.first) - 1
    hashes = np.insert(words.hashes, words.first[1:], END)
    return Tokens(hashes, np.repeat(np.arange(n), np.diff(words.first) + 1))


def features(tokens: Tokens) -> np.ndarray:
    """The three weights of each class that are active at each token (three rows)."""
    h, owner = tokens
    one, two = np.full(len(h), START), np.full(len(h), START)
    one[1:] = np.where(owner[1:] == owner[:-1], h[:-1], START)
    two[2:] = np.where(owner[2:] == owner[:-2], h[:-2], START)
    a, b, c, d = stream(30, 4)
    made = np.stack([mix(one * a), mix(one * b + two * c), mix(two * d)])
    return (made >> np.uint64(64 - BITS)).astype(np.int64)


class Vocabulary(NamedTuple):
    """The frequent words: sorted hashes, the count and the class of each; Z of each class, its logarithm to base 10."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    log_z: np.ndarray

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token whether it is frequent, its count (0 if not) and its class."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.full(len(hashes), CLASSES - 1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return known, np.where(known, self.counts[at], 0), np.where(known, self.classes[at], CLASSES - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for texts in slices(batch.column("text")):
            held.append(np.unique(tokens_of(texts).hashes, return_counts=True))
            size += len(held[-1][0])
            if size > 1 << 20:
                words, n = merged()
                held, size = [(words, n)], len(words)
                if size > 1 << 19:  # what one task holds stays bounded; Spark adds up the parts
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])
                    held, size = [], 0
    if held:
        words, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def vocabulary(counts: DataFrame, frequent: int) -> tuple[Vocabulary, int, int, int]:
    """The frequent words, the threshold of their counts, and the number of all tokens and of distinct ones."""
    steps = counts.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 8).alias("k")).agg(
        F.count("*").alias("v"), F.sum("n").alias("n"), F.min("n").alias("least")
    )  # fewer than 512 rows
    rows = sorted(steps.collect(), key=lambda r: -r["k"])
    total, distinct = sum(r["n"] for r in rows), sum(r["v"] for r in rows)
    least, taken = (max(r["least"] for r in rows) + 1 if rows else 1), 0
    for r in rows:
        if taken + r["v"] > frequent:
            break
        taken, least = taken + r["v"], r["least"]
    table = counts.where(F.col("n") >= least).toArrow()
    hashes = table.column("word").to_numpy().view(np.uint64)
    n = table.column("n").to_numpy()
    order = np.lexsort((hashes, -n))
    mass = np.cumsum(n[order]) - n[order]
    classes = np.empty(len(n), np.int64)
    classes[order] = mass * (CLASSES - 1) // max(1, n.sum())
    z = np.bincount(classes, n + 1, minlength=CLASSES)
    z[CLASSES - 1] = total - n.sum() + distinct - len(n) + 1
    by = np.argsort(hashes)
    return Vocabulary(hashes[by], n[by], classes[by], np.log10(np.maximum(z, 1))), least, int(total), int(distinct)


def log_softmax(by_slot: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Logarithms of the class probabilities, a row per class, from weights with a row per slot."""
    logits = by_slot.take(active[0], axis=0)
    for row in active[1:]:
        logits += by_slot.take(row, axis=0)
    logits += by_slot[BIAS]
    logits = np.ascontiguousarray(logits.T)
    logits -= logits.max(axis=0)
    logits -= np.log(np.exp(logits).sum(axis=0))
    return logits


def train(weights: np.ndarray, squares: np.ndarray, active: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on the gradient of a mini-batch, in place."""
    gap = np.exp(log_softmax(np.ascontiguousarray(weights.T), active))
    gap[target, np.arange(len(target))] -= 1
    slots, scale = active.ravel(), np.float32(1 / np.sqrt(len(target)))
    for c in range(len(weights)):
        gradient = np.bincount(slots, np.tile(gap[c], len(active)), minlength=BIAS + 1).astype(np.float32)
        gradient[BIAS] = gap[c].sum()
        gradient *= scale
        squares[c] += gradient * gradient
        weights[c] -= RATE * gradient / np.sqrt(squares[c] + np.float32(1e-6))


def _train(known: Vocabulary, weights: np.ndarray):
    names = ["slot", "seen", *[f"w{c}" for c in range(CLASSES)]]

    def run(rows: pa.Table) -> pa.Table:
        own, squares, seen = weights.copy(), np.zeros_like(weights), np.zeros(BIAS + 1, np.int64)
        rows = rows.sort_by([("_key", "ascending"), ("text", "ascending")])
        for texts in slices(rows.column("text")):
            tokens = tokens_of(texts)
            active, target = features(tokens), known.look_up(tokens.hashes)[2]
            for i in range(0, len(target), BATCH):
                train(own, squares, active[:, i : i + BATCH], target[i : i + BATCH])
            seen += np.bincount(active.ravel(), minlength=len(seen))
            seen[BIAS] += len(target)
        slots = np.flatnonzero(seen)
        scaled = own[:, slots].astype(np.float64) * seen[slots]
        return pa.table([pa.array(slots), pa.array(seen[slots]), *[pa.array(x) for x in scaled]], names)

    return run


def dealt(docs: DataFrame, tokens: int) -> DataFrame:
    """The rows with their part of training and their order in it, which only they decide; equal rows are interchangeable."""
    key = F.xxhash64("text", F.col("doc_id").cast("string"))
    parts = max(MIN_PARTS, -(-tokens // PART_TOKENS))
    return docs.select("text", key.alias("_key"), F.pmod(key, F.lit(parts)).alias("_part"))


def fit(docs: DataFrame, known: Vocabulary, rounds: int, tokens: int) -> np.ndarray:
    weights = np.zeros((CLASSES, BIAS + 1), np.float32)
    names = [f"w{c}" for c in range(CLASSES)]
    rows = dealt(docs, tokens)
    for _ in range(rounds):
        # parts are groups, not partitions of Spark: a cluster may cut these as it likes
        parts = rows.groupBy("_part").applyInArrow(_train(known, weights), ", ".join(["slot long", "seen long", *[f"{n} double" for n in names]]))
        # rounded, since sums of doubles depend on their order in the last digits
        mean = parts.groupBy("slot").agg(*[F.round(F.sum(n) / F.sum("seen"), 7).alias(n) for n in names]).toArrow()
        weights = weights.copy()
        weights[:, mean.column("slot").to_numpy()] = np.stack([mean.column(n).to_numpy() for n in names])
    return weights


def _score(known: Vocabulary, weights: np.ndarray):
    weights = np.ascontiguousarray(weights.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                n = texts.rows.stop - texts.rows.start
                tokens = tokens_of(texts)
                frequent, count, classes = known.look_up(tokens.hashes)
                active = features(tokens)
                chosen = np.concatenate([
                    log_softmax(weights, active[:, i : i + BATCH])[classes[i : i + BATCH], np.arange(min(BATCH, len(classes) - i))]
                    for i in range(0, len(classes), BATCH)
                ])
                base = np.bincount(tokens.owner, np.log10(count + 1.0), minlength=n)
                model = np.bincount(tokens.owner, chosen / np.log(10) - known.log_z[classes], minlength=n) + base
                rare = np.flatnonzero(~frequent)
                rare = rare[np.lexsort((tokens.hashes[rare], tokens.owner[rare]))]
                own, hashes = tokens.owner[rare], tokens.hashes[rare]
                new = np.append(True, (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1]))[: len(rare)]
                first = np.flatnonzero(new)
                offsets = np.append(0, np.cumsum(np.bincount(own[first], minlength=n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[texts.rows],
                        pa.array(np.bincount(tokens.owner, minlength=n)),
                        pa.array(np.bincount(tokens.owner[frequent], minlength=n)),
                        pa.array(base),
                        pa.array(model),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.diff(np.append(first, len(rare))))),
                    ],
                    ["doc_id", "n_tokens", "n_frequent", "base", "model", "words", "times"],
                )

    return run


def score(docs: DataFrame, training: DataFrame, rounds: int = 2, frequent: int = 200_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`, learning from `training` (text)."""
    counts = training.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    known, least, total, distinct = vocabulary(counts, frequent)
    weights = fit(training, known, rounds, total)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = f"doc_id {kind}, n_tokens long, n_frequent long, base double, model double, words array<long>, times array<long>"
    # written with its row numbers, which so stay the same in every use
    parts = written(docs.mapInArrow(_score(known, weights), types).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.times").alias("t"))
    rest = (
        rare.join(counts.where(F.col("n") < least), "word")
        .groupBy("row")
        .agg(F.sum(F.col("t") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("t").alias("seen"))
    )
    zero = F.lit(0)
    return parts.join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("seen", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: the remainder of the id's CRC by 7 is not 2."""
    return docs.where(remainder("doc_id", 7) != 2)
