"""Order-dependent work on keys that may hold a large share of all rows.

A window over one key runs in one task. Where a key is too large for that, its rows are cut into chunks
along the order, each chunk is worked on alone, and a small table of per-chunk totals carries the state
from chunk to chunk. Whether a table needs this is measured, never assumed, and both ways give the same
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: rows of one key that a single task may order
CHUNK_ROWS = 2_000_000
#: keys that get cut; any other key holds at most 1/MAX_HOT of the rows or CHUNK_ROWS
MAX_HOT = 1000
#: cut points per key
CUTS = 1023


def chunk_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("seqdrift.chunkRows", str(CHUNK_ROWS)))


def hot_keys(df: DataFrame, key: str, limit: int) -> list:
    """Keys with more than `limit` rows, largest first, at most MAX_HOT of them.

    Runs on the source table: the row count comes from file footers, and only a table larger than the
    limit is grouped, with partial sums before the shuffle.
    """
    if df.count() <= limit:
        return []
    large = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return [r[0] for r in large.orderBy(F.desc("n"), key).limit(MAX_HOT).collect() if r[0] is not None]


@dataclass(frozen=True)
class Cuts:
    """Cut points along the order for each hot key; empty when no key needs cutting."""

    key: str
    order: str
    table: DataFrame | None

    def assign(self, df: DataFrame) -> DataFrame:
        """Adds `chunk`: 0 for ordinary keys, the number of cut points below the value for hot ones."""
        if self.table is None:
            return df.withColumn("chunk", F.lit(0))
        value = F.col(self.order).cast("double")
        steps = F.array(*[F.lit(1 << p) for p in range((CUTS + 1).bit_length() - 2, -1, -1)])
        below = F.aggregate(
            steps,
            F.lit(0),
            lambda pos, step: F.when(F.get(F.col("cuts"), pos + step - 1) < value, pos + step).otherwise(pos),
        )
        # at most MAX_HOT rows of CUTS numbers: safe to broadcast
        joined = df.join(F.broadcast(self.table), self.key, "left")
        return joined.withColumn("chunk", F.when(F.col("cuts").isNull(), 0).otherwise(below)).drop("cuts")


def measure_cuts(df: DataFrame, key: str, order: str, limit: int | None = None) -> Cuts:
    """Finds the hot keys of a source table and even cut points along a numeric order column.

    The cut points are collected (MAX_HOT x CUTS numbers at most), so that every later use of them sees
    the same values, whatever order a sketch was merged in.
    """
    spark = df.sparkSession
    hot = hot_keys(df, key, limit or chunk_rows(spark))
    if not hot:
        return Cuts(key, order, None)
    fractions = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    rows = (
        df.where(F.col(key).isin(hot))
        .groupBy(key)
        .agg(F.percentile_approx(F.col(order).cast("double"), fractions, 10_000).alias("cuts"))
        .collect()
    )
    kind = df.select(key).schema[0].dataType.simpleString()
    return Cuts(key, order, spark.createDataFrame([tuple(r) for r in rows], f"{key} {kind}, cuts array<double>"))


def exclusive_sums(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column],
                   cuts: Cuts) -> DataFrame:
    """Sum of each value over the earlier rows of the same keys, 0 on the first row."""
    plain = cuts.table is None
    if not plain:
        df = cuts.assign(df)
    part = keys if plain else [*keys, "chunk"]
    before = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = {name: F.coalesce(F.sum(v).over(before), F.lit(0)) for name, v in values.items()}
    if plain:
        return df.select("*", *[s.alias(n) for n, s in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    hot_only = df.join(F.broadcast(cuts.table.select(cuts.key)), cuts.key, "left_semi")
    carry = hot_only.groupBy(*part).agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    carry = carry.select(*part, *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in values])
    out = df.select("*", *[s.alias(n) for n, s in sums.items()]).join(carry, part, "left")
    for n in values:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)))
    return out.drop("chunk", *[f"_{n}" for n in values])


def number_rows(df: DataFrame, key: str, order: list[Column], cuts: Cuts, name: str = "idx") -> DataFrame:
    """Position of each row within its key, from 0."""
    if cuts.table is None:
        return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)
    out = exclusive_sums(df, [key], order, {name: F.lit(1)}, cuts)
    return out.withColumn(name, F.col(name).cast("int"))


def previous_by_direction(df: DataFrame, key: str, value: str, direction: Column, chunk: int | None,
                          order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Adds `prev`: the last earlier value of the same key and direction (true or false), in idx order.

    One sort serves both directions. With `chunk`, keys are cut every `chunk` positions and the last value
    of each direction is carried over; use it when a key may be longer than one task should order. `order`
    names columns that sort like idx, to share a sort that an earlier step has already made.
    """
    df = df.withColumn("_dir", direction)
    part = [key]
    if chunk:
        df = df.withColumn("_chunk", F.floor(F.col("idx") / chunk).cast("long"))
        part, order = [key, "_chunk"], ("idx",)
        # a join by the key alone would satisfy the window below and leave all chunks of a key in one task
        df = df.repartition(*part)
    before = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)

    def last_of(side: bool) -> Column:
        mine = F.col("_dir") if side else ~F.col("_dir")
        return F.last(F.when(mine, F.col(value)), ignorenulls=True).over(before)

    inside = F.when(F.col("_dir"), last_of(True)).otherwise(last_of(False))
    if not chunk:
        return df.withColumn("prev", inside).drop("_dir")
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = df.groupBy(*part).agg(
        F.max_by(F.when(F.col("_dir"), F.col(value)), F.when(F.col("_dir") & F.col(value).isNotNull(), F.col("idx"))).alias("_fwd"),
        F.max_by(F.when(~F.col("_dir"), F.col(value)), F.when(~F.col("_dir") & F.col(value).isNotNull(), F.col("idx"))).alias("_bwd"),
    )
    carry = carry.select(
        *part, *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in ("_fwd", "_bwd")]
    ).where(F.col("_chunk") > 0)
    out = df.withColumn("prev", inside).join(carry, part, "left")
    carried = F.when(F.col("_dir"), F.col("_fwd")).otherwise(F.col("_bwd"))
    return out.withColumn("prev", F.coalesce("prev", carried)).drop("_dir", "_chunk", "_fwd", "_bwd")


def preceding(df: DataFrame, key: str, columns: list[str], k: int, chunk: int) -> DataFrame:
    """Adds `_lag1` .. `_lagk`: structs of the columns one to k positions earlier in the same key.

    Keys are cut every `chunk` positions, and the last k rows of a chunk are copied into the next one, so
    no task sees more than chunk + k rows of a key. Needs contiguous positions in `idx`.
    """
    if k == 0:
        return df
    home = F.floor(F.col("idx") / chunk).cast("long")
    reach = F.floor((F.col("idx") + k) / chunk).cast("long")
    if k > chunk:
        raise ValueError("chunk must be at least k")
    copies = df.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(home, reach)))
    w = W.partitionBy(key, "_chunk").orderBy("idx")
    lags = [F.lag(F.struct(*columns), j).over(w).alias(f"_lag{j}") for j in range(1, k + 1)]
    return copies.select("*", *lags).where(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk")
