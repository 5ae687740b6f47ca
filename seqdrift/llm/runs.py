"""Periodic runs of words by longest common extensions over a difference cover (op11).

A run is a stretch of words with smallest period q and length max(24, 3 q) or more that neither neighbour extends. Words q
apart are compared on the grid 0, q, 2 q, ... of each period: a run covers three grid points in a row, so a pair is followed
only where three words agree. There are n/1 + n/2 + ... grid points, and each pair is extended both ways at a constant price:

* positions whose remainder modulo 13 lies in {0, 1, 3, 9} are samples; for any two positions some shift below 13 makes
  samples of both, and only that many words are compared one by one;
* suffixes at samples are sorted (blocks of 13 words, then ranks of doubling length), neighbours get their common length from
  the ranks, and a sparse table of minima answers for any two samples.

The same over the reversed text extends to the left. Sorting begins when the first pair reaches its samples, which ordinary
prose never does. Words get numbers from a table of the text's own words, so equality is exact.

Null and blank texts have no words and no runs. Repeated rows give repeated rows; a null id is passed through. A text of any
length is one step of a task, with memory in proportion to its words (periods go in blocks of a million grid points). Equal
stretches found with several periods count once, with the smallest. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 is one of two members
GRID = 1 << 20  # grid points in a step
LEAST, TIMES = 24, 3

_SHIFT = np.zeros(MODULUS, np.int64)
for _a in COVER:
    for _b in COVER:
        _SHIFT[(_b - _a) % MODULUS] = _a


class Extensions:
    """Longest common extensions to the right, for pairs of positions of one sequence of numbers."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        self.ids = np.concatenate([ids, -1 - np.arange(2 * MODULUS)])  # an end that equals nothing
        self.rank: np.ndarray | None = None

    def _sort(self) -> None:
        sampled = np.zeros(self.n + MODULUS, bool)
        for c in COVER:
            sampled[c::MODULUS] = True
        at = np.flatnonzero(sampled)
        number = np.full(len(sampled) + 1, -1, np.int64)
        number[at] = np.arange(len(at))
        columns = [self.ids[at + k] for k in range(MODULUS)]
        order = np.lexsort(columns[::-1])
        fresh = np.zeros(len(at), bool)
        for c in columns:
            fresh[1:] |= c[order[1:]] != c[order[:-1]]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(fresh)
        step, levels = MODULUS, []

        def ahead(places: np.ndarray, by: int) -> np.ndarray:
            """Number of the sample `by` words on, -1 behind the end."""
            return number[np.minimum(at[places] + by, len(sampled))]

        while True:
            levels.append((step, rank))
            if rank.max() == len(at) - 1:
                break
            after = ahead(np.arange(len(at)), step)
            second = np.where(after < 0, 0, rank[after] + 1)
            rank = np.unique(rank * (len(at) + 1) + second, return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank)
        # common length of neighbours in order: from the longest ranks to the shortest, then word by word
        x, y, length = order[:-1].copy(), order[1:].copy(), np.zeros(len(at) - 1, np.int64)
        for step, known in reversed(levels[:-1] if len(levels) > 1 else []):
            same = np.flatnonzero((x >= 0) & (y >= 0) & (known[x] == known[y]))
            length[same] += step
            x[same], y[same] = ahead(x[same], step), ahead(y[same], step)
        left, right = at[order[:-1]] + length, at[order[1:]] + length
        length += self._compare(left, right, np.full(len(length), MODULUS))
        self.rank = np.full(len(sampled), -1, np.int64)
        self.rank[at] = rank
        self.minima = [length]
        while 2 << (len(self.minima) - 1) <= len(length):
            low, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(low[:-half], low[half:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from two positions on, at most `most`, less than a block."""
        length, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
        last = len(self.ids) - 1
        for k in range(MODULUS):
            open_ = open_[most[open_] > k]
            a, b = np.minimum(i[open_] + k, last), np.minimum(j[open_] + k, last)
            open_ = open_[(self.ids[a] == self.ids[b]) & (a != b)]
            if not len(open_):
                break
            length[open_] += 1
        return length

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair of different positions."""
        shift = (_SHIFT[(j - i) % MODULUS] - i) % MODULUS
        length = self._compare(i, j, shift)
        both = np.flatnonzero(length == shift)
        both = both[np.maximum(i[both], j[both]) + shift[both] < self.n]
        if len(both):
            if self.rank is None:
                # pairs that differ at their samples need no order
                both = both[self.ids[i[both] + shift[both]] == self.ids[j[both] + shift[both]]]
                if not len(both):
                    return length
                self._sort()
            x, y = self.rank[i[both] + shift[both]], self.rank[j[both] + shift[both]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                table = self.minima[k]
                length[both[at]] += np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return length


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, position) of all grid points with two more behind them in n words, in steps."""
    q, last = 1, n // TIMES
    while q <= last:
        # counts fall with the period, so the first of a step bounds them
        upper = min(last, q + max(0, GRID // max(1, (n - 1) // q - 1)))
        periods = np.arange(q, upper + 1)
        counts = (n - 1) // periods - 1
        period = np.repeat(periods, counts)
        step = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield period, step * period
        q = upper + 1


def runs_of(ids: np.ndarray) -> np.ndarray:
    """All runs of a sequence of numbers: rows (start, length, period) by start, then period."""
    n = len(ids)
    found = [np.zeros((0, 3), np.int64)]
    if n >= LEAST:
        right, left = Extensions(ids), Extensions(ids[::-1])
        for q, i in grid(n):
            third = np.flatnonzero(ids[i] == ids[i + q])
            third = third[ids[i[third]] == ids[i[third] + 2 * q[third]]]
            q, i = q[third], i[third]
            if not len(q):
                continue
            ahead = right.of(i, i + q)
            far = np.flatnonzero(ahead >= q)  # from the first grid point of a run at least two periods are left
            if not len(far):
                continue
            q, i, ahead = q[far], i[far], ahead[far]
            start = i - left.of(n - i, n - i - q)
            length = i + q + ahead - start
            kept = length >= np.maximum(LEAST, TIMES * q)
            found.append(np.unique(np.stack([start, length, q], 1)[kept], axis=0))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(1)  # the same stretch with a multiple of its period
    rows = rows[~again]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that any run repeats: of each run the first period stays."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def strongest(runs: np.ndarray) -> int | None:
    """The run that repeats most, by exact length over period; of equals the first."""
    if not len(runs):
        return None
    order = range(len(runs))
    if len(runs) > 64:  # those near the highest quotient, the exact comparison decides
        share = runs[:, 1] / runs[:, 2]
        order = np.flatnonzero(share >= share.max() * (1 - 1e-12)).tolist()
    return max(order, key=lambda k: (Fraction(int(runs[k, 1]), int(runs[k, 2])), -runs[k, 0], -runs[k, 2]))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_runs, first, best, texts, sizes = [], [0], [], [], []
        for text in batch.column("text").cast(pa.large_binary()):
            words = (text.as_py() or b"").split()  # bytes: exactly \x20 and \x09 to \x0D
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            runs = runs_of(ids)
            all_runs.append(runs)
            first.append(first[-1] + len(runs))
            k = strongest(runs)
            best.append(None if k is None else dict(zip(("start", "length", "period"), runs[k].tolist())))
            texts.append(b" ".join(collapsed(words, runs)))
            sizes.append(len(words))
        flat = np.concatenate(all_runs) if all_runs else np.zeros((0, 3), np.int64)
        members = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), members),
             pa.array(best, RUN), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), strongest run or null, collapsed text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<{RUN_SQL}>, strongest {RUN_SQL}, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)


def implanted(docs: DataFrame) -> DataFrame:
    """Every tenth document by crc32(doc_id), with a period worked into its words from some word on; the others as they are."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def periodic(words: Column) -> Column:
        g, n = F.floor(mark / 10), F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("bigint"), n - a - 1), lambda k: F.get(words, (a + k % p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")

    # one element, so that the words are split once
    planted = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise("")), 1)
    return docs.select("doc_id", F.when(mark % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run, and digests of the runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "strongest.*",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
