"""Merkle manifest of a dataset by concatenated-level strings (op13).

Each row is a leaf: the sha256 of five length-prefixed fields. Leaves of a source are numbered by doc_id and cut into
aligned blocks of 3**6. A block keeps a whole level of its tree as one string of hex digests, 64 characters a node: a
fixed-width substring of three nodes hashes to the parent, so the next level is one pass over the string, and the substrings
on both sides of a node within its run of three are its siblings. The digests of the blocks are nodes of the next pass,
those of the sources of the last one; passes end where a group fits one block. On the way down each block hands its own
path to its nodes, so paths are joined by block and never by row.

Rows with the same id and source are ordered by their leaf; equal rows have equal leaves and take places next to each other.
A null id comes first, is written `-` in the leaf and is never tampered with. A null text is the field `-`, an empty one `0:`.
Texts of any length are hashed whole. An empty table has no rows and no root. Columns other than the five are not read.
Numbers come from range partitions that were counted, so a hot source is spread over tasks; no group but a block is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqdrift.llm.base import written

ARITY = 3
DEPTH = 6
BLOCK = ARITY**DEPTH
WIDTH = 64  # hex digits of a digest
RUN = ARITY * WIDTH

PATH = "array<struct<l:binary,r:binary>>"


def field(value: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, digest, altered): `g` orders sources, null first. `altered` is the leaf of the row as tampered with: texts of
    rows whose crc32(doc_id) is even lose their line breaks."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    digest = leaf(F.col("text"))
    broken = even & F.contains("text", F.lit("\n"))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("g"),
        "doc_id",
        digest.alias("digest"),
        F.when(broken, leaf(F.translate("text", "\n", ""))).alias("altered"),
    )


def numbered(rows: DataFrame, group: str, order: list[str], purpose: str) -> DataFrame:
    """Adds `pos`, the place of a row in its group from 0, and `n`, the rows of the group.

    Rows are dealt to sorted ranges, written, and counted by range and group; a row's place is its place in the range plus
    what lies in the ranges before. A group that is larger than a range lies in several.
    """
    keys = [group, *order, "_tie"]
    dealt = written(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{purpose}-rows").repartitionByRange(*keys)
    dealt = written(dealt.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), f"{purpose}-ranges")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    counts = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = W.partitionBy(group).orderBy("_range")
    counts = counts.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), "_first",
        (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(group)).alias("n"),
    )
    joined = dealt.join(counts, (F.col(group) == F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_g", "_r", "_first", "_before")


def parents(level: Column) -> Column:
    """The next level as one string: every run of three digests of this one, hashed."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    hashed = F.transform(runs, lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256))
    return F.array_join(hashed, "").cast("binary")


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(g, block, n, items, levels): a block's nodes in order, and its levels from the nodes to the digest of the block.

    Levels are hex text held as bytes, where a substring does not count characters from the start. A block of a larger group
    climbs all its levels, a group that is one block stops at its root.
    """
    item = F.struct("pos", "digest", *payload)
    cut = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    grouped = cut.groupBy("g", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))

    def climb(done: Column, _: Column) -> Column:
        top = F.element_at(done, -1)
        return F.when((F.col("n") > BLOCK) | (F.length(top) > WIDTH), F.concat(done, F.array(parents(top)))).otherwise(done)

    first = F.array(F.array_join(F.transform("items", lambda x: x["digest"]), "").cast("binary"))
    return grouped.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), first, climb))


def siblings(levels: Column, place: Column) -> Column:
    """By level, what stands left and right of a node's ancestor within its run; the last level is the block's own digest."""

    def at(level: Column, j: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(ARITY)), j)).cast("int")
        run = F.floor(own / ARITY).cast("int") * ARITY
        return F.struct(
            F.substring(level, run * WIDTH + 1, (own - run) * WIDTH).alias("l"),
            F.substring(level, (own + 1) * WIDTH + 1, (run + ARITY - 1 - own) * WIDTH).alias("r"),
        )

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


class Forest:
    """Trees over numbered nodes (g, pos, n, digest), one a group: block tables pass by pass, and the roots (g, digest)."""

    def __init__(self, nodes: DataFrame, payload: list[str], purpose: str) -> None:
        self.payload, self.tables, self.roots = payload, [], None
        while True:
            table = written(blocks(nodes, payload if not self.tables else []), f"{purpose}-blocks")
            self.tables.append(table)
            top = F.element_at("levels", -1).cast("string")
            done = table.where(F.col("n") <= BLOCK).select("g", top.alias("digest"))
            self.roots = done if self.roots is None else self.roots.unionByName(done)
            larger = table.where(F.col("n") > BLOCK)
            if larger.isEmpty():
                break
            nodes = larger.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), top.alias("digest"))

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """(g, pos, digest, payload, path) with `path` from each node to the root of its group, and on along `above` (g, path)."""
        nodes = None
        for depth in reversed(range(len(self.tables))):
            table = self.tables[depth]
            whole = table.where(F.col("n") <= BLOCK)
            if above is None:
                whole = whole.withColumn("_up", F.array().cast(PATH))
            else:
                whole = whole.join(above.select("g", F.col("path").alias("_up")), "g")
            if nodes is not None:
                own = nodes.select("g", F.col("pos").alias("block"), F.col("path").alias("_up"))
                whole = whole.unionByName(table.where(F.col("n") > BLOCK).join(own, ["g", "block"]))
            kept = ["pos", "digest", *(self.payload if depth == 0 else [])]

            def with_path(item: Column, k: Column) -> Column:
                path = F.concat(siblings(F.col("levels"), k), F.col("_up")).cast(PATH)
                return F.struct(*[item[c].alias(c) for c in kept], path.alias("path"))  # noqa: B023 - called at once

            nodes = whole.select("g", F.inline(F.transform("items", with_path)))
        return nodes


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["l"], acc.cast("binary"), s["r"]), 256))


def segments(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.aggregate(path, F.lit("").cast("binary"), lambda acc, s: F.concat(acc, s["l"], s["r"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path, altered leaf or null; one row per row of the table."""
    nodes = numbered(leaves(docs), "g", ["doc_id", "digest"], "manifest")
    forest = Forest(nodes, ["doc_id", "altered"], "manifest")
    roots = written(forest.roots, "manifest-subroots")
    one = roots.select(F.lit("").alias("g"), F.col("g").alias("source_key"), "digest")
    tree = Forest(numbered(one, "g", ["source_key"], "manifest-top"), ["source_key"], "manifest-top")
    root = tree.roots.first()
    above = written(tree.paths().select(F.col("source_key").alias("g"), "path", F.col("digest").alias("subroot")), "manifest-sources")
    rows = forest.paths(above).join(above.select("g", "subroot"), "g")
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root and root["digest"]).cast("string").alias("root"), "path", "altered")


def verified(table: DataFrame) -> DataFrame:
    """The manifest's rows with the digest of each proof, and the root recomputed from the leaf as it is now."""
    now = folded(F.coalesce("altered", "leaf"), F.col("path"))
    out = table.withColumn("folded_root", now).withColumn("proof_sha256", F.sha2(segments(F.col("path")), 256))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


__all__ = ["Forest", "folded", "leaves", "manifest", "numbered", "segments", "verified"]
