"""Packing of tokenized documents into fixed windows by minimum bin slack.

A document's full windows are sequences of their own; its tail is shorter than a window. Tails are packed by their
lengths alone: of the multiset of remaining lengths the longest opens a window, a bitset says which sums the others can
reach, the sum with the least padding is taken and walked back to counts of lengths. The same choice is repeated as
often as the counts allow, so the plan has a few choices per length, however many documents there are: it works on at
most `capacity` counts. Spark then numbers the tails of each length, within hashed ranges and a table of range counts,
and joins them with the plan; a length that a third of all documents have is spread over many ranges.

Ids are those of the given tokenizer. Where it is plain byte-level BPE with ids in the order of its merges, distinct pieces of
words go through the same ranks in a faster library; all others, and any with a special token, through the tokenizer itself.

Padding: a sequence is filled up to `capacity`, except where its length is a power of two.
Null text: as empty, so the end id alone. Null ids and repeated rows are packed like any other. Very long texts are steps of their own
and fill many windows. Ties: of two choices with equal padding the fuller one; equal tails are interchangeable. An empty table has
no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqdrift.llm.base import frugal, written
from seqdrift.llm.words import Texts, hashed, slices

END_ID = 0
MEMO = 1_500_000  # pieces a worker remembers before it starts afresh


def padding(length: int, capacity: int) -> int:
    return 0 if length & (length - 1) == 0 else capacity - length


def choose(remaining: dict[int, int], capacity: int) -> Counter:
    """The lengths that, with the longest one, leave the least padding of a window."""
    longest = max(remaining)
    room, chosen = capacity - longest, Counter({longest: 1})
    mask, layers, reach = (1 << room + 1) - 1, [], 1
    for length in sorted(remaining, reverse=True):
        free = min(remaining[length] - (length == longest), room // length)
        if free <= 0:
            continue
        layers.append((length, free, reach))
        step = 1
        while free:
            take = min(step, free)
            reach |= reach << take * length & mask
            free, step = free - take, step * 2
        if reach >> room & 1:
            break
    sums = [room] if reach >> room & 1 else [i for i in range(room + 1) if reach >> i & 1]
    target = min(sums, key=lambda s: (padding(longest + s, capacity), -s))
    for length, free, reach in reversed(layers):
        used = next(n for n in range(free + 1) if target >= n * length and reach >> target - n * length & 1)
        if used:
            chosen[length] += used
            target -= used * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, copies in a window, first window, offset) that say where each tail goes."""
    remaining, used, window = {k: n for k, n in counts.items() if n}, Counter(), 0
    while remaining:
        chosen = choose(remaining, capacity)
        times = min(remaining[k] // n for k, n in chosen.items())
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            yield length, used[length], used[length] + n * times, n, window, offset
            offset += n * length
            used[length] += n * times
            remaining[length] -= n * times
            if not remaining[length]:
                del remaining[length]
        window += times


# Kinds of bytes: ASCII white space, blank, point, ASCII letter, first byte of white space outside ASCII
SPACE, BLANK, POINT, LETTER, LEAD = 1, 2, 4, 8, 16
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t\n\r\x0b\x0c")] = SPACE
KIND[32] |= BLANK
KIND[list(b".,;:!?")] = POINT
KIND[65:91] = KIND[97:123] = LETTER
KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = LEAD
STEP = 1 << 19  # bytes that are worked on together


def piece_starts(texts: Texts) -> np.ndarray:
    """Where a text may be cut without changing its ids.

    The tokenizer's pattern begins a new match at white space after anything else, at a point after a letter, and
    after a single white space other than a blank. In doubt, near white space outside ASCII, nothing is cut.
    """
    kind, bounds = KIND[texts.data], texts.bounds
    n = len(kind)
    # the end of white space, perhaps of some outside ASCII
    near = kind & (SPACE | LEAD)
    near[2:] |= near[:-2] & LEAD
    near[1:] |= kind[:-1] & LEAD
    near = near != 0
    space = (kind & SPACE) != 0
    cut = np.zeros(n, bool)
    cut[1:] = (space[1:] & ~near[:-1]) | (kind[1:] & POINT).astype(bool) & (kind[:-1] & LETTER).astype(bool)
    if n > 2:
        cut[2:] |= ((kind[2:] & (SPACE | LEAD)) == 0) & ((kind[1:-1] & (SPACE | BLANK)) == SPACE) & ~near[:-2]
    cut[bounds[:-1][bounds[:-1] < n]] = True
    return np.flatnonzero(cut)


class Memo:
    """Ids of known pieces: two sorted tables of hashes, a large one and recent ones that join it when they are a quarter of
    it, with where the ids of each lie in one growing array. A few dozen bytes a piece."""

    def __init__(self):
        self.tables = [self._table(), self._table()]  # hashes, where the ids begin, how many
        self.ids, self.n_ids = np.zeros(1 << 12, np.uint32), 0

    @staticmethod
    def _table():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def add(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        at = np.cumsum(size) - size + self.n_ids
        if self.n_ids + len(ids) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.n_ids + len(ids)), np.uint32)
            grown[: self.n_ids] = self.ids[: self.n_ids]
            self.ids = grown
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        large, recent = self.tables
        recent = self._joined(recent, (hashes, at, size))
        if 4 * len(recent[0]) > len(large[0]):
            large, recent = self._joined(large, recent), self._table()
        self.tables = [large, recent]

    @staticmethod
    def _joined(one, other):
        place = np.searchsorted(one[0], other[0])
        return tuple(np.insert(a, place, b) for a, b in zip(one, other, strict=True))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each begin, how many they are, and which of the hashes are known."""
        at, size, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        for table in self.tables:
            if len(table[0]):
                place = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
                own = table[0][place] == hashes
                at[own], size[own], known = table[1][place[own]], table[2][place[own]], known | own
        return at, size, known

    def take(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of pieces one after the other."""
        before = np.cumsum(size) - size
        return self.ids[np.arange(int(size.sum())) + np.repeat(at - before, size)]


# Fixed value: how byte-level tokenizers split a text
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(path: str):
    """The same tokenizer as ranks, which is faster; None unless it is plain byte-level BPE whose ids come in the order of its merges."""
    import tiktoken

    spec = json.loads(Path(path).read_text())
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    whole = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    if not (plain and whole and spec.get("normalizer") is None):
        return None
    # byte-level files write each byte as a printable character: those that are one as themselves, the others from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ids = model["vocab"]
    merged = [ids.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    if merged != sorted(merged) or merged[:1] == [-1]:
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in ids.items() if token not in added}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def loaded(path: str) -> tuple:
    """The tokenizer of a file and the same one as ranks. A worker keeps them for its next tasks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), ranked(path)


class Encoder:
    """Ids of whole texts, each distinct piece of them encoded once for as long as it is remembered."""

    def __init__(self, path: str):
        self.tokenizer, self.ranks = loaded(path)
        # what has not been used since the memo was half full goes, the rest stays
        self.memo, self.old = Memo(), Memo()
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids."""
        parts = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        ids = [e.ids for e in parts]
        return np.array([len(x) for x in ids], np.int32), np.array([i for x in ids for i in x], np.uint32)

    def _encode_lines(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces without white space but for one leading blank: a line break between two is an id of its own."""
        sizes, all_ids = [], []
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            text = b"\n".join(part).decode("utf-8", "replace")
            if self.ranks is not None and not any(t in text for t in self.special):
                ids = np.array(self.ranks.encode_ordinary(text), np.uint32)
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            breaks = ids == self.line[0]
            ends = np.append(np.flatnonzero(breaks), len(ids))
            sizes.append(np.diff(np.append(-1, ends)) - 1)
            all_ids.append(ids[~breaks])
        return np.concatenate(sizes).astype(np.int32), np.concatenate(all_ids)

    def _remember(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes)
        at = np.cumsum(sizes) - sizes
        before = np.cumsum(sizes[order]) - sizes[order]
        moved = ids[np.arange(len(ids)) + np.repeat(at[order] - before, sizes[order])]
        self.memo.add(hashes[order], sizes[order], moved)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a few texts, and how many each has."""
        data, n = texts.data, len(texts.bounds) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        starts = piece_starts(texts)
        lengths = np.diff(np.append(starts, len(data)))
        hashes = hashed(np.append(data, np.zeros(8, np.uint8)), starts, lengths)
        # a piece goes by its 64-bit hash: of a billion different pieces two agree with a probability of 3 %
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, size, known = self.memo.find(unique)
        if not known.all():
            if len(self.memo) > MEMO // 2 or self.memo.n_ids > 4 * MEMO:
                self.memo, self.old = Memo(), self.memo
                known[:] = False
            old_at, old_size, old = self.old.find(unique[~known])
            new = np.flatnonzero(~known)[~old]
            hashes, sizes, ids = [unique[~known][old]], [old_size[old]], [self.old.take(old_at[old], old_size[old])]
            raw, begin = data.tobytes(), first[new]
            pieces = [raw[a:b] for a, b in zip(starts[begin].tolist(), (starts[begin] + lengths[begin]).tolist(), strict=True)]
            odd = (KIND[data] & (SPACE | LEAD)) != 0
            odd[starts] &= (data[starts] != 32) | (lengths == 1)
            plain = ~np.maximum.reduceat(odd, starts)[begin] if len(self.line) == 1 else np.zeros(len(new), bool)
            for which, encode in ((plain, self._encode_lines), (~plain, self._encode)):
                if which.any():
                    counts, own = encode([p for p, w in zip(pieces, which, strict=True) if w])
                    hashes.append(unique[new[which]]), sizes.append(counts), ids.append(own)
            hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
            self._remember(hashes, sizes, np.concatenate(ids))
            at, size, _ = self.memo.find(unique)
        size = size[inverse]
        ids = self.memo.take(at[inverse], size)
        owner = np.searchsorted(texts.bounds, starts, "right") - 1
        return ids, np.bincount(owner, size, minlength=n).astype(np.int64)


def _tokenize(path: str, capacity: int, with_ids: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for texts in slices(batch.column("text"), STEP):
                ids, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                raw, counts = np.insert(ids, ends, np.uint32(END_ID)).astype("<u4").tobytes(), counts + 1
                ends = np.cumsum(counts)
                cut = [
                    [raw[4 * k : 4 * min(k + capacity, b)] for k in range(a, b, capacity)]
                    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)
                ]
                columns = [
                    batch.column("doc_id")[texts.rows],
                    pa.array(counts),
                    pa.array([[zlib.crc32(p) for p in c] for c in cut], pa.list_(pa.int64())),
                ]
                if with_ids:
                    columns.append(pa.array(cut, pa.list_(pa.binary())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "crcs", "ids"][: len(columns)])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    with_ids: also `ids`, the piece's ids as unsigned 32-bit little-endian numbers.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_tokens long, crcs array<long>" + ", ids array<binary>" * with_ids
    tokens = written(docs.mapInArrow(_tokenize(tokenizer_path, capacity, with_ids), schema), "tokens")
    tokens = tokens.withColumn("_tail", F.expr(f"int(doc_tokens % {capacity})")).withColumn("_full", F.expr(f"doc_tokens div {capacity}"))
    counts = {r["_tail"]: r["n"] for r in tokens.groupBy("_tail").agg(F.count("*").alias("n")).collect()}  # one per length
    total = sum(counts.values())
    counts.pop(0, None)
    ranges = max(1, int(total**0.5))
    rows = list(plan(counts, capacity))
    windows = max((first + -(-(hi - lo) // n) for _, lo, hi, n, first, _ in rows), default=0)
    fields = ["_tail", "_lo", "_hi", "_copies", "_first", "_offset"]
    where = T.StructType([T.StructField("_tail", T.IntegerType()), *[T.StructField(f, T.LongType()) for f in fields[1:]]])
    # a few choices per length: bounded by the capacity, not by the documents
    placed = F.broadcast(spark.createDataFrame(rows, where))

    order = ["doc_id", "doc_tokens", "crcs"]
    tokens = tokens.withColumn("_range", F.expr(f"pmod(xxhash64(doc_id), {ranges})"))

    def earlier(df: DataFrame, by: list[str], what) -> DataFrame:
        sums = df.groupBy(*by, "_range").agg(what.alias("_n"))
        w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")

    payload = ["crcs", *["ids"] * with_ids]
    tails = tokens.where("_tail > 0").select("doc_id", "doc_tokens", "_tail", "_full", "_range", *[F.element_at(c, -1).alias(c) for c in payload])
    rank = F.row_number().over(Window.partitionBy("_tail", "_range").orderBy(*order)) - 1
    tails = (
        tails.withColumn("_rank", rank)
        .join(earlier(tails, ["_tail"], F.count("*")), ["_tail", "_range"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .join(placed, "_tail")
        .where("_rank >= _lo and _rank < _hi")
    )
    extra = [F.col("ids")] * with_ids
    tails = tails.select(
        "doc_id",
        F.expr(f"_full * {capacity}").alias("start"),
        F.col("_tail").cast("long").alias("length"),
        F.col("crcs").alias("ids_crc32"),
        "doc_tokens",
        F.expr("_first + (_rank - _lo) div _copies").alias("sequence_id"),
        F.expr("_offset + (_rank - _lo) % _copies * _tail").alias("offset"),
        *extra,
    )
    whole = tokens.where("_full > 0")
    sofar = F.sum("_full").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    whole = (
        whole.withColumn("_sofar", F.coalesce(sofar, F.lit(0)))
        .join(earlier(whole, [], F.sum("_full")), "_range")
        .select(
            "doc_id",
            "doc_tokens",
            F.expr(f"{windows} + _before + _sofar").alias("_base"),
            F.posexplode(F.expr("slice(arrays_zip({}), 1, int(_full))".format(", ".join(payload)))).alias("_k", "_p"),
        )
        .select(
            "doc_id",
            F.expr(f"_k * {capacity}L").alias("start"),
            F.lit(capacity).cast("long").alias("length"),
            F.col("_p.crcs").alias("ids_crc32"),
            "doc_tokens",
            F.expr("_base + _k").alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
            *[F.col("_p.ids").alias("ids")] * with_ids,
        )
    )
    return tails.union(whole)
