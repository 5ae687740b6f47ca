"""Rule bitmask ledger: each rule is evaluated once per document, policies and ablations only read the bits.

`ledger` stores measurements and one bit per failed rule. `apply_policy` keeps documents that fail none of a
version's rules. `ablation` says per rule how many documents the policy would keep without it, from the counts of
distinct bitmasks (at most two to the number of rules, however many documents there are).

Words are runs of characters other than space and U+0009 to U+000D. Null text: no words, so it fails the word count.
A word counts as repeated if it lies in a three-word window that occurs twice or more in its text. All work stays
within a row: no shuffle, and a very long text is one row like any other. A null id is passed through, an empty table has no rows.
There are no ties. Repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"

# name, condition of failure; the bit is the place in the list, so append only
RULES: list[tuple[str, Column | str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
]
BASE = 0b11
POLICIES = {"base": BASE, "v1": BASE | 0b011000, "v2": BASE | 0b111100}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.translate("_text", SPACE, "")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    words = docs.select("doc_id", text.alias("_text")).select(
        "doc_id",
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(solid) - F.length(F.translate(solid, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.filter(F.split("_text", "[ \\t-\\r]+", -1), lambda x: x != "").alias("_words"),
    )
    hashed = words.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2))),
            F.lit(1),
            F.greatest(F.size("_words") - 2, F.lit(0)),
        ).alias("_windows"),
    )
    same = F.size(F.array_distinct("_windows")) == F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    # windows in the order of their hashes, places of equal ones side by side; most texts have none to sort
    ordered = F.when(same, none).otherwise(
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    )
    alike = F.filter(
        "_ordered",
        lambda x, i: F.coalesce(
            (x["h"] == F.get("_ordered", i - 1)["h"]) | (x["h"] == F.get("_ordered", i + 1)["h"]), F.lit(False)
        ),
    )
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    places = (
        hashed.select(*kept, ordered.alias("_ordered"))
        .select(*kept, F.sort_array(F.transform(alike, lambda x: x["i"])).alias("_places"))
    )
    # each window covers three words, or as many as lie before the next one
    reach = F.transform("_places", lambda x, i: F.least(F.lit(3), F.get("_places", i + 1) - x))
    total = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return places.select(*kept, total.alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `fail_bits`, with bit i set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measures(docs).withColumn("fail_bits", bits)


def apply_policy(table: DataFrame, version: str = "v2") -> DataFrame:
    mask = POLICIES[version]
    return table.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0,
    })


def ablation(table: DataFrame, version: str = "v2") -> DataFrame:
    """rule, n_fail, n_only (dropped by this rule alone), n_kept, n_kept_without."""
    mask = POLICIES[version]
    masks = table.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("_bits")).agg(F.count("*").alias("_n"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    per = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules]))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("_n"))), F.lit(0))
    return (
        masks.select("_bits", "_n", per.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            count(F.col("_bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_fail"),
            count(F.col("_bits") == F.col("r.bit")).alias("n_only"),
            count(F.col("_bits") == 0).alias("n_kept"),
            count(F.col("_bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
        )
    )
