"""Passages that repeat across documents, by sparse suffix arrays.

1. Of each window of `length` words one run of GRAM words is chosen by content, the one with the least hash
   (minimiser). Equal windows choose alike, so only suffixes at chosen positions are kept, about one word in twenty.
2. Chosen runs that occur in one document only are dropped. Of the others the context is read: the words before and
   after, as far as a window around the run can reach. Equal contexts are one entry.
3. Entries are sorted by run and following words, and by run and preceding words, in ranges that no frequent run can
   fill. Neighbours are compared and their matches extended right and left. The longest common stretch to the right and
   to the left of an entry is one with a neighbour, so no window reaches beyond either.
4. The longest match to the right need not be the longest in all. Where the matches leave a window within both reaches
   open, the windows of the entries of that run are counted by hash, so the result is exact: a word is reported if and
   only if it lies in a window of `length` words that also occurs in another document.

Rows of one id count as one document. Null ids and null texts: nothing to report. Texts shorter than a window neither. Very long texts
are steps of their own. Ties of sorted entries change neighbours, not results, which are exact. An empty table has no rows.
Other columns are ignored. A result row: doc_id, first_word, end_word (the last one is left out), n_words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.base import written
from seqdrift.llm.words import NOT_SPACE, grams, inside_text, mix, slices, words_of

GRAM = 8
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best (np.minimum or np.maximum) of each run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.append(values, np.full(-len(values) % width, values[-1]))
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def chosen(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all minimisers, and the hash of the run at each."""
    runs, width = grams(hashes, GRAM), length - GRAM + 1
    window, _ = inside_text(first, length)
    if not len(window):
        return np.zeros(0, np.int64), runs[:0]
    least = sliding(runs, width, np.minimum)
    valid = np.zeros(len(least), bool)
    valid[window] = True
    least[~valid] = 0
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)  # over the windows that hold a run
    at = np.flatnonzero((most == runs) & (most > 0))
    return at, runs[at]


def _choose(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                words = words_of(texts, NOT_SPACE)
                at, runs = chosen(words.hashes, words.first, length)
                owner = np.searchsorted(words.first, at, "right") - 1
                ids = batch.column("doc_id")[texts.rows].take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(runs.view(np.int64)), pa.array(at - words.first[owner])], ["doc_id", "run", "at"]
                )

    return run


def _contexts(length: int):
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                words = words_of(texts, NOT_SPACE)
                short = (words.hashes >> np.uint64(32)).astype("<u4")
                rows: list[tuple] = []
                for i, places in enumerate(batch.column("places")[texts.rows].to_pylist()):
                    doc, a, b = batch.column("doc_id")[texts.rows.start + i].as_py(), words.first[i], words.first[i + 1]
                    own = grams(words.hashes[a:b], GRAM).view(np.int64)
                    for p in places:
                        # the same id may stand before another text too
                        if p["at"] < len(own) and own[p["at"]] == p["run"]:
                            at = a + p["at"]
                            left = short[max(a, at - reach) : at][::-1]
                            rows.append((doc, p["run"], p["at"], short[at : min(b, at + length)].tobytes(), left.tobytes()))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "run", "at", "right", "left"]
                )

    return run


RANGES = "array<struct<a:int,b:int>>"


def common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y)) // 4
    gap = np.flatnonzero(np.frombuffer(x, "<u4", n) != np.frombuffer(y, "<u4", n))
    return int(gap[0]) if len(gap) else n


def _neighbours(length: int, side: str):
    """Of entries sorted by run and `side` what matches with their neighbours cover, and how far they agree on that side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows = None, []

        def opened(x: dict, edge: bool) -> dict:
            whole = (-(len(x["left"]) // 4), len(x["right"]) // 4)
            x["found"] = {whole} if x["low"] != x["high"] else set()
            # what stands beyond the border of a task is not known
            x["reach"] = len(x[side]) // 4 if edge or x["found"] else 0
            return x

        def compare(x: dict, y: dict) -> None:
            if x["run"] != y["run"]:
                return
            right, left = common(x["right"], y["right"]), common(x["left"], y["left"])
            for z in (x, y):
                z["reach"] = max(z["reach"], right if side == "right" else left)
            if left + right >= length and not x["low"] == x["high"] == y["low"] == y["high"]:
                for z in (x, y):
                    z["found"].add((-left, right))

        def out() -> pa.RecordBatch:
            columns = [
                pa.array([x["entry"] for x in rows], pa.int64()),
                pa.array([[{"a": a, "b": b} for a, b in sorted(x["found"])] for x in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                pa.array([x["reach"] for x in rows], pa.int32()),
            ]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["entry", "ranges", "reach"])

        for batch in batches:
            for x in batch.to_pylist():
                x = opened(x, before is None)
                if before is not None:
                    compare(before, x)
                    rows.append(before)
                before = x
            yield out()
        if before is not None:
            before["reach"] = len(before[side]) // 4
            rows.append(before)
            yield out()

    return run


def _windows(length: int):
    """Hashes of the windows of entries whose offsets lie between `first` and `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, h = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for left, right, first, last in zip(*[batch.column(c).to_pylist() for c in ("left", "right", "first", "last")], strict=True):
                words = np.concatenate([np.frombuffer(left, "<u4")[::-1], np.frombuffer(right, "<u4")])
                zero = len(left) // 4
                h.append(grams(mix(words[zero + first : zero + last + length].astype(np.uint64)), length, 50))
                a.append(np.arange(first, last + 1))
                n.append(last + 1 - first)
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(rows) for c in ("entry", "low", "high")],
                    pa.array(np.concatenate(a).astype(np.int32)),
                    pa.array(np.concatenate(h).view(np.int64)),
                ],
                ["entry", "low", "high", "a", "window"],
            )

    return run


def repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, first_word, end_word, n_words of every stretch of words that lie in a window found in another document too."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = written(docs.mapInArrow(_choose(length), f"doc_id {kind}, run long, at long"), "minimisers")
    runs = picked.groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    # small sides of joins are written first: Spark then splits the keys that are frequent on the large side
    runs = written(runs.select("run"), "repeated-runs")
    places = picked.join(runs, "run", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("run", "at")).alias("places"))
    found = docs.join(places, "doc_id").mapInArrow(_contexts(length), f"doc_id {kind}, run long, at long, right binary, left binary")
    found = written(found.withColumn("entry", F.xxhash64("run", "right", "left")), "contexts")
    entries = found.groupBy("entry", "run", "right", "left").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    entries = written(entries, "entries")
    sides = []
    for side, other in (("right", "left"), ("left", "right")):
        order = ["run", side, other, "entry"]
        dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order)
        sides.append(written(dealt.mapInArrow(_neighbours(length, side), f"entry long, ranges {RANGES}, reach int"), f"by-{side}"))
    by_right, by_left = (x.select("entry", F.col("ranges").alias(f"r{i}"), F.col("reach").alias(f"reach{i}")) for i, x in enumerate(sides))
    compared = by_right.join(by_left, "entry").select("entry", F.array_union("r0", "r1").alias("ranges"), "reach0", "reach1")
    compared = written(compared, "neighbours")
    # the windows that another entry may hold too, and whether all of them lie in a match
    offsets = (
        entries.join(compared, "entry")
        .withColumn("first", F.expr("int(-reach1)"))
        .withColumn("last", F.expr(f"int(reach0 - {length})"))
        .where("first <= last")
        .withColumn("open", F.expr(f"exists(sequence(first, last), x -> not exists(ranges, r -> r.a <= x and x + {length} <= r.b))"))
    )
    unclear = offsets.groupBy("run").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("open and n > 1").select("run")
    unclear = written(unclear, "unclear-runs")
    windows = written(
        offsets.drop("ranges").join(unclear, "run", "left_semi").mapInArrow(_windows(length), f"entry long, low {kind}, high {kind}, a int, window long"),
        "windows",
    )
    shared = windows.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("window")
    shared = written(shared, "shared-windows")
    more = windows.join(shared, "window", "left_semi").select("entry", "a", (F.col("a") + length).alias("b"))
    ranges = compared.select("entry", F.explode("ranges").alias("r")).select("entry", "r.a", "r.b").union(more)
    # a few dozen ranges an entry at most
    ranges = written(ranges.groupBy("entry").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "ranges")
    spans = (
        found.select("entry", "doc_id", "at")
        .join(ranges, "entry")
        .select("doc_id", F.explode(F.transform("ranges", lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"]).alias("b")))).alias("s"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("s")).alias("spans"))
    )
    # overlapping and adjoining spans become one
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    merged = F.aggregate(
        "spans",
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return spans.select("doc_id", F.explode(merged).alias("s")).select(
        "doc_id", F.col("s.a").alias("first_word"), F.col("s.b").alias("end_word"), (F.col("s.b") - F.col("s.a")).alias("n_words")
    )
