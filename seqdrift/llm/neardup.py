"""Near-duplicate groups by SuperMinHash signatures.

1. A document's shingle set (hashed to 64 bits) gives a class key of 128 bits; copies with equal sets are one class,
   stood for by its smallest doc_id.
2. SuperMinHash: each element draws ranks 0, 1, 2... for the components in a random order of its own; the values of
   one element are correlated, and a text is done as soon as no later rank can lower a component.
3. Three components make a band. Each bucket is a star: its members are compared with one of them only, the one whose
   buckets are the fullest, which in a group of near copies lies near the middle.
4. Links are confirmed on full sets and components found by union of the links.
5. Buckets whose other members are still in several components are settled exactly, in one of two ways, whichever
   compares fewer pairs for that cluster of buckets: matching rarest shingles (two sets with Jaccard 0.75 share one of
   their n/4 + 1 rarest), or, in a dense cluster of almost similar documents, comparing blocks of documents with
   blocks, where a task holds two blocks and returns links alone. Neither emits the pairs of a group.

A pair at the threshold shares none of the 32 bands with probability 2e-8, one above it with less.

Null or blank text: an empty set, linked with nothing. Fewer words than a shingle: the whole sequence is the one
shingle. Repeated rows each get their row. Where rows share an id but not their text, links of either may count for
both. Null id: linked with nothing, component null, kept. Very long texts: their whole sets, hashed, are one step of a task. Ties:
of equally full members of a bucket the one with the smaller class key is the star; groups do not depend on it. An empty table has
no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm import base
from seqdrift.llm.words import NOT_SPACE, Words, grams, inside_text, mix, slices, stream, words_of

written = functools.partial(base.written, compression="zstd")  # a dozen tables of hashes and ids side by side

ROWS, BANDS = 3, 32
STEP = 1_000_000  # links that a task makes stars of at once
BLOCK = 256  # documents of a block, or as many as have 1000 times as many shingles


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ordered by text and shingle, and the text of each."""
    at, owner = inside_text(words.first, k)
    hashes = grams(words.hashes, k)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):  # the whole sequence, mixed with its length
        whole = [grams(words.hashes[words.first[i] : words.first[i + 1]], int(counts[i]), 100 + int(counts[i]))[0] for i in short]
        hashes, owner = np.append(hashes, np.array(whole, np.uint64)), np.append(owner, short)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n by m) of the sets given as elements and the number of the set of each; an empty set stays infinite."""
    sig = np.full(n * m, np.inf)
    swaps, perm = None, None
    low = np.uint64(0xFFFFFFFF)
    for j, salt in enumerate(stream(5, m)):
        x = mix(elements ^ salt)
        value = (x >> np.uint64(32)).astype(np.float64) / 2**32 + j
        k = j + ((x & low) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = swaps = k
        else:
            if perm is None:  # most texts need rank 0 alone, so permutations begin with rank 1
                perm = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                every = np.arange(len(elements))
                perm[every, swaps] = 0
                perm[every, 0] = swaps
            every = np.arange(len(elements))
            slot = perm[every, k]
            perm[every, k] = perm[every, j]
            perm[every, j] = slot
        np.minimum.at(sig, owner * m + slot, value)
        open_ = sig.reshape(n, m).max(axis=1) > j + 1
        stay = open_[owner]
        if not stay.all():
            elements, owner, swaps = elements[stay], owner[stay], swaps[stay]
            perm = None if perm is None else perm[stay]
        if not len(elements):
            break
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature, different for different bands."""
    n, m = sig.shape
    bits = sig.view(np.uint64).reshape(n, m // rows, rows)
    return mix((bits * stream(6, rows)).sum(axis=2, dtype=np.uint64) + stream(7, m // rows))


def _signatures(k: int, rows: int, bands: int):
    @base.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                n = texts.rows.stop - texts.rows.start
                sets, owner = shingle_sets(words_of(texts, NOT_SPACE), k)
                size = np.bincount(owner, minlength=n)
                filled = size > 0
                at = (np.cumsum(size) - size)[filled]
                k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(sets):
                    k1[filled] = np.add.reduceat(mix(sets), at)
                    k2[filled] = np.add.reduceat(mix(sets ^ stream(8, 1)), at)
                keys = band_keys(superminhash(sets, owner, n, rows * bands), rows).view(np.int64)[filled]
                offsets = np.append(0, np.cumsum(filled * bands)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[texts.rows.start : texts.rows.stop],
                        pa.array(size.astype(np.int64)),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def _sets(k: int):
    @base.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                n = texts.rows.stop - texts.rows.start
                sets, owner = shingle_sets(words_of(texts, NOT_SPACE), k)
                offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[texts.rows.start : texts.rows.stop],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.view(np.int64))),
                    ],
                    ["doc_id", "shingles"],
                )

    return run


#: bits that stand for ids in `perhaps`, 8 MB of them
ID_BITS = 1 << 26


def marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`docs` with `_perhaps`, true at each row whose id is in `wanted` (doc_id) and at few others, from a broadcast bitmap of ids."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    bit = F.col("_at") % 32768
    marks = wanted.select(at.alias("_at")).groupBy(F.expr("_at div 32768").alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.expr("int(_at % 32768 div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    placed = docs.withColumn("_at", at).withColumn("_part", F.expr("_at div 32768")).join(F.broadcast(marks), "_part", "left")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, int(_at % 8))")) != 0
    return placed.select(*docs.columns, F.coalesce(hit, F.lit(False)).alias("_perhaps"))


def perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `docs` whose id may be in `wanted` (doc_id), none of which is lost: most others go before a join deals out their texts."""
    return marked(docs, wanted).where("_perhaps").select(*docs.columns)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is not in `gone` (doc_id), null ids among them; only rows whose id may be in it are dealt out."""
    placed = marked(docs, gone)
    # an anti join would be moved in front of the filter
    doubtful = placed.where("_perhaps").join(gone.select("doc_id", F.lit(True).alias("_gone")), "doc_id", "left").where("_gone is null")
    return placed.where("not _perhaps").select(*docs.columns).union(doubtful.select(*docs.columns))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a pair may come more than once."""
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_sa")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_sb")), "b")
        .where(100 * F.least(F.size("_sa"), F.size("_sb")) >= percent * F.greatest(F.size("_sa"), F.size("_sb")))
        .withColumn("_common", F.size(F.array_intersect("_sa", "_sb")))
    )
    return both.where(100 * F.col("_common") >= percent * (F.size("_sa") + F.size("_sb") - F.col("_common"))).select("a", "b")


def contracted(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars around the smallest id of each component of the links v, u: every other id once, and that smallest id."""
    ids, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    root, x, y = np.arange(len(ids)), at[: len(v)], at[len(v) :]
    while True:
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
        if not len(x):
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    leaf = root != np.arange(len(ids))
    return ids[leaf], ids[root[leaf]]


@base.frugal
def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (v, u) as stars, STEP links of a task at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        columns = contracted(table["v"].to_numpy(), table["u"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, table.schema)], schema=table.schema)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= STEP:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(links: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest id reachable) of every id in `links` (a, b), written.

    Each task replaces its links by stars, which leaves an id at most one smaller neighbour a step of a task. While they are
    no stars yet taken together, larger neighbours of an id pass to the smallest id it knows, and so do its smaller ones.
    The smallest neighbour of an id never grows, and where none falls in a round, what comes out are stars.
    """
    kind = links.schema["a"].dataType.simpleString()
    links = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    links = written(links.mapInArrow(_contracted, f"v {kind}, u {kind}"), "links")
    while True:
        both = links.select(F.col("v").alias("id"), F.col("u").alias("other")).union(links.select("u", "v"))
        least = both.groupBy("id").agg(F.min("other").alias("_low"), F.max("other").alias("_high"))
        # in stars, an id with a smaller neighbour has no other neighbour
        least = written(least.select("id", F.least("_low", "id").alias("m"), F.expr("_low < id and _low <> _high").alias("open")), "least")
        if not least.agg(F.max("open")).first()[0]:
            return least.select(F.col("id").alias("doc_id"), F.col("m").alias("component_id"))
        large = links.join(least.select(F.col("id").alias("u"), "m"), "u").select("v", F.col("m").alias("u")).mapInArrow(_contracted, f"v {kind}, u {kind}")
        # an id has no more smaller neighbours here than the tasks before had steps
        small = large.groupBy("v").agg(F.min("u").alias("m"), F.collect_set("u").alias("_us"))
        ends = small.select(F.explode(F.concat(F.array("v"), "_us")).alias("v"), F.col("m").alias("u"))
        links = written(ends.where("v <> u"), "links")


def rare_shingles(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, cluster, component, n, s: of each document its rarest shingles that another one has among its own.

    Sorted by how many of the documents have it, a set of n shingles that is similar to another shares with it one of
    its first n - ceil(n * percent / 100) + 1.
    """
    named = sets.join(docs, "doc_id").select(*docs.columns, F.size("shingles").alias("n"))
    each = sets.join(docs, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    # a shingle that no other document has comes first in the order, so counting those is enough
    return (
        each.join(common, "s")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("f", "s")).alias("_all"))
        .join(named, "doc_id")
        .withColumn("_take", F.expr(f"n - ceil(n * {percent} / 100) + 1 - (n - size(_all))"))
        .where("_take > 0")
        .select(*docs.columns, "n", F.expr("explode(slice(sort_array(_all), 1, int(_take))) as p"))
        .select(*docs.columns, "n", "p.s")
    )


def rare_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents in different components that share one of their rarest shingles."""
    other = prefix.select(F.col("doc_id").alias("b"), F.col("component").alias("_cb"), F.col("n").alias("_nb"), "s")
    return (
        prefix.withColumnRenamed("doc_id", "a")
        .join(other, "s")
        .where((F.col("a") < F.col("b")) & (F.col("component") != F.col("_cb")))
        .where(100 * F.least("n", "_nb") >= percent * F.greatest("n", "_nb"))
        .select("a", "b")
        .distinct()
    )


def _compare(percent: int):
    """Confirmed links between two blocks, or within one, of documents in different components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        ids, label, block = rows["doc_id"].to_numpy(), rows["component"].to_numpy(), rows["block"].to_numpy()
        size = np.array([len(x) for x in rows["shingles"]])
        values = np.unique(np.concatenate(rows["shingles"].tolist()), return_inverse=True)[1]
        first = np.cumsum(size) - size
        flags = np.zeros(values.max() + 1, np.int64)
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        found: list[tuple] = []
        for x in np.flatnonzero(block == rows["i"].iloc[0]):
            own = values[first[x] : first[x] + size[x]]
            flags[own] = 1
            shared = np.add.reduceat(flags[values], first)
            flags[own] = 0
            near = (100 * shared >= percent * (size + size[x] - shared)) & (label != label[x])
            near &= np.arange(len(ids)) > x if same else block == rows["j"].iloc[0]
            found += [(ids[x], ids[y]) for y in np.flatnonzero(near)]
        # a link per pair of components is enough, and bounds what a task returns
        once = {(min(label_of), max(label_of)): p for p in found for label_of in [(label[ids == p[0]][0], label[ids == p[1]][0])]}
        return pd.DataFrame({"a": [p[0] for p in once.values()], "b": [p[1] for p in once.values()]}, dtype=ids.dtype)

    return run


def block_links(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of one cluster and different components, from comparing its blocks with one another.

    docs: doc_id, cluster, component, blocks (of the cluster).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.withColumn("block", F.expr("int(pmod(xxhash64(doc_id), blocks))")).withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
    return (
        placed.join(sets, "doc_id")
        .select("doc_id", "cluster", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "shingles")
        .groupBy("cluster", "i", "j")
        .applyInPandas(_compare(percent), f"a {kind}, b {kind}")
    )


def settle(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of unsettled buckets (doc_id, band, component) that are in different components."""
    # merge joins by band, here and below: Spark splits a full bucket in them
    first = rest.groupBy("band").agg(F.min("doc_id").alias("a"))
    chained = components(rest.join(first.hint("merge"), "band").select("a", F.col("doc_id").alias("b")))
    docs = written(rest.select("doc_id", "component").distinct().join(chained.withColumnRenamed("component_id", "cluster"), "doc_id"), "clusters")
    prefix = written(rare_shingles(docs.select("doc_id", "cluster", "component"), sets, percent), "rare-shingles")
    by_rare = prefix.groupBy("cluster", "s").agg(F.count("*").alias("f")).groupBy("cluster").agg(F.sum(F.expr("f * (f - 1) / 2")).alias("rare"))
    sizes = (
        docs.join(sets, "doc_id")
        .groupBy("cluster")
        .agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("total"))
        .withColumn("blocks", F.expr(f"int(greatest(ceil(n / {BLOCK}), ceil(total / {BLOCK * 1000})))"))
        .join(by_rare, "cluster", "left")
        .withColumn("dense", F.expr("coalesce(rare, 0) > n * (n - 1) / 2"))
    )
    sizes = written(sizes, "cluster-sizes")
    dense = docs.join(sizes.where("dense").select("cluster", "blocks"), "cluster")
    sparse = prefix.join(sizes.where("not dense").select("cluster"), "cluster", "left_semi")
    pairs = written(rare_pairs(sparse, percent), "rare-pairs")
    # written, as `components` works on them in Python too: two workers a task would stand side by side
    by_blocks = written(block_links(dense, sets, percent), "block-links")
    return confirmed(pairs, sets, percent).union(by_blocks)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    schema = docs.select("doc_id").schema
    signed = written(
        docs.mapInArrow(_signatures(k, rows, bands), f"doc_id {schema[0].dataType.simpleString()}, n_shingles long, k1 long, k2 long, bands array<long>"),
        "signatures",
    )
    named = signed.where("doc_id is not null")
    classes = named.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("head"))
    classes = written(classes, "classes")
    heads = named.join(classes.withColumnRenamed("head", "doc_id"), ["k1", "k2", "n_shingles", "doc_id"], "left_semi")
    buckets = heads.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    full = written(buckets.join(shared, "band"), "buckets")
    # rows may share an id but not their text, so an id has a least and a greatest size
    middle = full.groupBy("doc_id").agg(F.sum("n").alias("p"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    stars = full.select("doc_id", "band").join(middle, "doc_id").groupBy("band").agg(F.max(F.struct("p", "doc_id", "low", "high")).alias("top"))
    stars = stars.select("band", F.col("top.doc_id").alias("star"), "top.low", "top.high")
    members = full.join(stars.hint("merge"), "band").where("doc_id <> star")
    members = written(members.select("doc_id", "band", "star", "n_shingles", "low", "high"), "members")
    alike = 100 * F.least("n_shingles", "high") >= percent * F.greatest("n_shingles", "low")
    pairs = written(members.where(alike).select(F.col("star").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    named_there = members.select("doc_id").union(members.select("star"))
    wanted = named_there.distinct()
    # ids are distinct; a semi join would be moved in front of the filter
    sets = written(
        perhaps(docs, named_there).join(wanted, "doc_id").mapInArrow(_sets(k), f"doc_id {schema[0].dataType.simpleString()}, shingles array<long>"),
        "sets",
    )
    found = components(confirmed(pairs, sets, percent))
    left = members.join(found, "doc_id", "left").select("doc_id", "band", F.coalesce("component_id", "doc_id").alias("component"))
    mixed = left.groupBy("band").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("band")
    rest = written(left.join(mixed.hint("merge"), "band", "left_semi"), "unsettled")
    more = settle(rest, sets, percent)
    stars = found.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    final = components(stars.union(more)).withColumnRenamed("doc_id", "head")
    grouped = written(classes.join(final, "head", "left").withColumn("component_id", F.coalesce("component_id", "head")).drop("head"), "groups")
    return (
        signed.join(grouped, ["k1", "k2", "n_shingles"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
