"""Proportional stratified interleaving of documents into shards.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its place within its
source on a scale from 0 to 1. All rows ordered by fractional rank and cut into equal lengths give shards whose
mixture of sources is that of the whole.

Ranks over all rows need no single ordered task: the hash (then the fractional rank) cuts rows into about
sqrt(rows) ranges of even size, hot sources included; rows are numbered within a range, and a table of range
counts, as long as there are ranges, says how many come before.

Law: `rows`, counts of any two shards differ by one at most.
Null text: size 1, CRC of no bytes. Null source: a stratum of its own. Null id: shuffled as an empty id.
Equal rows: each gets a slot; which one is interchangeable. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqdrift.llm.base import written

DIGITS = 13  # hex digits of the hash that choose a range: 52 bits, exact in a double


def before(counts: DataFrame, by: list[str], along: str) -> DataFrame:
    """Adds how many rows lie in earlier ranges (`_before`) and in all of them (`_all`)."""
    w = Window.partitionBy(*by)
    ordered = w.orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({"_before": F.coalesce(F.sum("_n").over(ordered), F.lit(0)), "_all": F.sum("_n").over(w)})


def _draw(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def interleave(docs: DataFrame, shards: int = 16, seed: str = "0") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard (null: this law is not by key), fraction."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_stratum"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _draw(seed).alias("_draw"),
        ),
        "shard-rows",
    )
    total = rows.count()
    ranges = max(1, int(total**0.5))
    order = ["_draw", "doc_id", "text_crc32", "size"]
    unit = F.conv(F.substring("_draw", 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)
    rows = rows.withColumn("_range", F.floor(unit * ranges))
    counts = before(rows.groupBy("_stratum", "_range").agg(F.count("*").alias("_n")), ["_stratum"], "_range")
    place = F.row_number().over(Window.partitionBy("_stratum", "_range").orderBy(*order))
    ranked = (
        rows.withColumn("_place", place)
        .join(counts, ["_stratum", "_range"])
        .withColumn("fraction", (2 * (F.col("_before") + F.col("_place")) - 1) / (2.0 * F.col("_all")))
        .drop("_range", "_place", "_before", "_all", "_n")
    )
    ranked = written(ranked.withColumn("_range", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1))), "shard-ranks")
    counts = before(ranked.groupBy("_range").agg(F.count("*").alias("_n")), [], "_range")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("fraction", *order))
    at = F.col("_before") + F.col("_place") - 1
    return (
        ranked.withColumn("_place", place)
        .join(counts, "_range")
        .withColumn("_at", at)
        .withColumn("shard", F.expr(f"int((_at * {shards}) div {max(total, 1)})"))
        .select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"_at - (shard * bigint({total}) + {shards - 1}) div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "fraction",
        )
    )
