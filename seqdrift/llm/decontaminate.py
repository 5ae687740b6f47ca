"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of a task's texts. Its words, as numbers of benchmark words (runs of other words are one
separator), get a suffix array, its Burrows-Wheeler transform and a wavelet matrix for ranks. All windows of the
benchmark are searched backwards at once; what is found is located through sampled suffix positions, and overlapping
occurrences are merged into removal spans.

A window: `k` consecutive words of an item; an item of fewer words is one window. The benchmark is searched in blocks
of at most `block_chars` characters (one block for any usual benchmark), so that what a task holds stays bounded.
Null or blank texts: no words, clean. Null item id: an id of its own, the empty string. Repeated rows each get their
row; items with equal words are searched once. Very long texts are shards of their own. Empty benchmark: every document is clean; an
empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.base import frugal
from seqdrift.llm.words import ALNUM, Words, covered, slices, words_of

END, BREAK, FIRST = 0, 1, 2  # symbols of an index: end of the shard, separator, first benchmark word
SHARD = 1 << 21  # bytes of text
RATE = 8  # every so many positions of the text are kept


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling; only groups that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.append(True, np.diff(symbols[order]) != 0)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    single = new & np.append(new[1:], True)
    places, h = np.flatnonzero(~single), 1
    while len(places):
        at = order[places]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[places] = at
        new = np.append(True, np.diff(key) != 0)
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        places = places[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class Wavelets:
    """Ranks of symbols in a sequence: one bit of every symbol per level."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.levels = []
        for bit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            ones = (sequence >> bit & 1).astype(bool)
            zeros = np.append(0, np.cumsum(~ones, dtype=np.int32))
            self.levels.append((bit, zeros))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        self.base = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, zeros in self.levels:
            left = zeros[at].astype(np.int64)
            at = np.where(symbols >> bit & 1, zeros[-1] + at - left, left)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbols, at) - self.base[symbols]


class Index:
    """An FM-index of symbols that end with END, which stands nowhere else."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.waves = Wavelets(self.bwt, n_symbols)
        self.before = np.append(0, np.cumsum(np.bincount(symbols, minlength=n_symbols)))
        kept = order % RATE == 0
        self.kept, self.kept_before, self.sample = kept, np.cumsum(kept) - kept, order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of patterns (one a row, of equal length): the numbers of those that occur, and their ranges of rows."""
        which = np.arange(len(patterns))
        last = patterns[:, -1]
        low, high = self.before[last], self.before[last + 1]
        for column in reversed(range(patterns.shape[1] - 1)):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
            symbol = patterns[which, column]
            low = self.before[symbol] + self.waves.rank(symbol, low)
            high = self.before[symbol] + self.waves.rank(symbol, high)
        alive = low < high
        return which[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes given by their rows: back to the next kept position."""
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            found = self.kept[rows]
            out[open_[found]] = self.sample[self.kept_before[rows[found]]] + steps
            open_, rows = open_[~found], rows[~found]
            symbol = self.bwt[rows]
            rows = self.before[symbol] + self.waves.rank(symbol, rows)
            steps += 1
        return out


class Windows(NamedTuple):
    """A block of the benchmark: its words in order, and by length the different windows and which items hold each.

    Items with the same windows are one holder, so that what is found of a text names each holder once."""

    vocabulary: np.ndarray  # sorted hashes
    items: list[list[str]]  # of each holder, the ids
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # symbols (one window a row), first holder of each, holders


def windows_of(items: list[tuple[str, str]], k: int) -> Windows:
    texts = pa.array([t for _, t in items], pa.string())
    holders: dict[bytes, int] = {}
    ids: list[list[str]] = []
    by_length: dict[int, list] = {}
    hashes = []
    for part in slices(texts):
        words = words_of(part, ALNUM)
        for i in range(part.rows.stop - part.rows.start):
            own = words.hashes[words.first[i] : words.first[i + 1]]
            if not len(own):
                continue
            holder = holders.setdefault(own.tobytes(), len(ids))
            if holder == len(ids):
                ids.append([])
                width = min(k, len(own))
                by_length.setdefault(width, []).append((np.lib.stride_tricks.sliding_window_view(own, width), holder))
                hashes.append(own)
            ids[holder].append(items[part.rows.start + i][0])
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    groups = []
    for _, own in sorted(by_length.items()):
        symbols = np.searchsorted(vocabulary, np.concatenate([v for v, _ in own])) + FIRST
        symbols, inverse = np.unique(symbols, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), np.concatenate([np.full(len(v), i) for v, i in own])], 1), axis=0)
        groups.append((symbols, np.searchsorted(pairs[:, 0], np.arange(len(symbols) + 1)), pairs[:, 1]))
    return Windows(vocabulary, ids, groups)


class Hits(NamedTuple):
    words: Words
    hit: np.ndarray  # of each word
    pairs: np.ndarray  # distinct (text, holder), one a row


def hits_of(words: Words, windows: Windows) -> Hits:
    """Which words of a shard lie in an occurrence of a window, and which items occur in which text."""
    n, hit = len(words.hashes), np.zeros(len(words.hashes), bool)
    none = Hits(words, hit, np.zeros((0, 2), np.int64))
    if not n or not len(windows.vocabulary):
        return none
    number = np.minimum(np.searchsorted(windows.vocabulary, words.hashes), len(windows.vocabulary) - 1)
    known = windows.vocabulary[number] == words.hashes
    opens = np.zeros(n, bool)
    opens[words.first[:-1][words.first[:-1] < n]] = True
    # a separator before a known word that begins a text or follows an unknown word
    known_at = np.flatnonzero(known)
    if not len(known_at):
        return none
    split = opens[known_at] | np.append(True, np.diff(known_at) > 1)
    place = np.arange(len(known_at)) + np.cumsum(split)
    symbols = np.full(int(place[-1]) + 2, BREAK)
    symbols[place], symbols[-1] = number[known_at] + FIRST, END
    index = Index(symbols, len(windows.vocabulary) + FIRST)
    word_of = np.zeros(len(symbols), np.int64)
    word_of[place] = known_at
    pairs = []
    for patterns, first, holder in windows.groups:
        which, low, high = index.search(patterns)
        if not len(which):
            continue
        times = high - low
        which = np.repeat(which, times)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        begin = word_of[index.locate(rows)]
        hit |= covered(begin, patterns.shape[1], n)
        text = np.searchsorted(words.first, begin, "right") - 1
        text, which = np.unique(np.stack([text, which], 1), axis=0).T  # each window of a text once, then its holders
        times = first[which + 1] - first[which]
        of = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[which], times)
        pairs.append(np.unique(np.stack([np.repeat(text, times), holder[of]], 1), axis=0))
    return Hits(words, hit, np.unique(np.concatenate(pairs), axis=0) if pairs else none.pairs)


SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(windows: Windows):
    """Rows doc_id, text_key, n_words, item_ids, spans (words first to last, last one out; characters start to end)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), SHARD):
                n = texts.rows.stop - texts.rows.start
                words, hit, pairs = hits_of(words_of(texts, ALNUM), windows)
                items: list[list] = [[] for _ in range(n)]
                spans: list[list] = [[] for _ in range(n)]
                for text, item in pairs.tolist():
                    items[text] += windows.items[item]
                for text in np.unique(pairs[:, 0]).tolist():
                    a, b = words.first[text], words.first[text + 1]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
                    zero = texts.bounds[text]
                    # characters before each byte: all but the bytes that go on a character
                    chars = np.append(0, np.cumsum((texts.data[zero : texts.bounds[text + 1]] & 0xC0) != 0x80))
                    first, last = edges[::2], edges[1::2]
                    start, end = chars[words.starts[a + first] - zero], chars[words.ends[a + last - 1] - zero]
                    spans[text] = [
                        {"first": i, "last": j, "start": p, "end": q}
                        for i, j, p, q in zip(first.tolist(), last.tolist(), start.tolist(), end.tolist(), strict=True)
                    ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[texts.rows],
                        batch.column("text_key")[texts.rows],
                        pa.array(np.diff(words.first)),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(spans, pa.list_(SPAN)),
                    ],
                    ["doc_id", "text_key", "n_words", "item_ids", "spans"],
                )

    return run


def _without(windows: Windows):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), SHARD):
                clean = np.ones(texts.rows.stop - texts.rows.start, bool)
                clean[hits_of(words_of(texts, ALNUM), windows).pairs[:, 0]] = False
                yield batch.slice(texts.rows.start, len(clean)).filter(pa.array(clean))

    return run


def blocks(benchmark: DataFrame, k: int, block_chars: int) -> Iterator[Windows]:
    """The benchmark's windows, in blocks whose texts together have about `block_chars` characters at most."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    chars = bench.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b)
        yield windows_of([(r["id"], r["t"]) for r in part.collect()], k)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans: a row for each row of `docs`."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_words long, item_ids array<string>, "
        "spans array<struct<first:long,last:long,start:long,end:long>>"
    )
    found = [docs.mapInArrow(_scan(w), schema) for w in blocks(benchmark, k, block_chars)]
    out = found[0].withColumn("item_ids", F.array_sort(F.array_distinct("item_ids")))
    if len(found) > 1:
        more = found[1].where("size(item_ids) > 0")
        for x in found[2:]:
            more = more.union(x.where("size(item_ids) > 0"))
        more = more.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text_key").agg(
            F.flatten(F.collect_set("item_ids")).alias("_items"), F.flatten(F.collect_set("spans")).alias("_spans")
        )
        both = lambda a, b: F.array_sort(F.array_union(a, F.coalesce(b, F.array().cast(out.schema[a].dataType))))
        out = (
            out.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
            .join(more, ["_id", "text_key"], "left")
            .withColumns({"item_ids": both("item_ids", F.col("_items")), "spans": both("spans", F.col("_spans"))})
        )
    # spans of one block are merged already; those of several may overlap
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["last"]).alias("at"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(a["at"], s["first"]))).alias("n"),
        ),
    )["n"]
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") > 0).alias("contaminated"),
        "item_ids",
        "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_chars: int = 1 << 20) -> DataFrame:
    """The rows of `docs`, with all their columns, in whose text no window occurs."""
    for windows in blocks(benchmark, k, block_chars):
        docs = docs.mapInArrow(_without(windows), docs.schema)
    return docs
