"""Row sampling that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqdrift.functions.numeric import uniform


def _u(seed: int) -> Column:
    return uniform(F.lit(seed), F.col("conn_id"))


def bernoulli(flows: DataFrame, rate: float, seed: int) -> DataFrame:
    """Keeps each flow with probability `rate`, by a hash of its id."""
    if not 0.0 < rate <= 1.0:
        raise ValueError("rate must be in (0, 1]")
    return flows if rate == 1.0 else flows.where(_u(seed) < rate)


def smallest(flows: DataFrame, rows: int, seed: int) -> DataFrame:
    """Exactly `rows` flows (or all, if fewer): those with the smallest uniform, ties by id.

    One pass replaces sampling at a rate and trying again with a higher one. Flows are counted per slice
    of the uniform, whole slices below the wanted number are kept as they are, and only the slice that
    holds the border is ordered. Nothing but 65,536 counts meets in one task, however large `rows` is.
    """
    if rows < 0:
        raise ValueError("rows must not be negative")
    slices = 65_536
    tagged = flows.withColumn("_u", _u(seed)).withColumn("_slice", F.floor(F.col("_u") * slices).cast("int"))
    sizes = tagged.groupBy("_slice").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.orderBy("_slice"))
    sizes = sizes.withColumn("_room", F.lit(rows) - (upto - F.col("_n"))).where(F.col("_room") > 0)
    near = tagged.join(F.broadcast(sizes), "_slice")
    whole = near.where(F.col("_n") <= F.col("_room"))
    border = near.where(F.col("_n") > F.col("_room")).withColumn(
        "_rank", F.row_number().over(W.partitionBy("_slice").orderBy("_u", "conn_id"))
    ).where(F.col("_rank") <= F.col("_room"))
    return whole.select(flows.columns).unionByName(border.select(flows.columns))


def capped(flows: DataFrame, rate: float, rows: int | None, seed: int) -> DataFrame:
    """Bernoulli sample, then at most `rows` of it. If the sample is too small, the next flows by uniform
    fill it up, so the result is always the `rows` smallest; no flow comes twice."""
    if rows is None:
        return bernoulli(flows, rate, seed)
    if not 0.0 < rate <= 1.0:
        raise ValueError("rate must be in (0, 1]")
    return smallest(flows, rows, seed)
