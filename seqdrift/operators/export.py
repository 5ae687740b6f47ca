"""Wide feature matrix: one row per flow, a fixed number of columns, -1 where a flow has ended."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.functions.numeric import snapped
from seqdrift.schema import FEATURES

PADDING = -1.0


def _signed(size: Column, direction: Column, with_direction: bool) -> Column:
    """Direction has no column of its own: it is the sign of the size. A bin 0 has no sign to carry it."""
    return F.when(direction > 0.5, size).otherwise(-size) if with_direction else size


def _wide(rows: DataFrame, key: list[str], num_packets: int, values: dict[str, Column], snap: bool) -> DataFrame:
    """Pivot by conditional maximum. Rows beyond num_packets are cut and partial maxima formed before the
    shuffle, so a long flow costs no more than num_packets rows."""
    columns = []
    for i in range(num_packets):
        for name, value in values.items():
            x = F.max(F.when(F.col("idx") == i, value.cast("double")))
            x = F.coalesce(snapped(x) if snap else x, F.lit(PADDING)) + F.lit(0.0)
            columns.append(x.alias(f"{name}_{i:03d}"))
    return rows.where(F.col("idx") < num_packets).groupBy(*key).agg(*columns)


def for_every_flow(matrix: DataFrame, flows: DataFrame) -> DataFrame:
    """The matrix with a row for each of `flows` (conn_id, perhaps rtt): padding alone where a flow has no packets."""
    values = [c for c in matrix.columns if c not in flows.columns]
    joined = flows.join(matrix.select("conn_id", *values), "conn_id", "left")
    return joined.select(*flows.columns, *[F.coalesce(c, F.lit(PADDING)).alias(c) for c in values])


def _check(features: Iterable[str]) -> set[str]:
    features = set(features)
    if features - set(FEATURES):
        raise ValueError(f"invalid feature: {sorted(features - set(FEATURES))}")
    return features


def long_enough(features: DataFrame, min_packets: int) -> DataFrame:
    """Flows with at least min_packets packets. Counted on the frame as given, so after stripping."""
    if min_packets <= 0:
        return features
    counted = features.groupBy("conn_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_packets)
    return features.join(counted.select("conn_id"), "conn_id", "left_semi")


def raw_matrix(features: DataFrame, num_packets: int, active: Iterable[str] = FEATURES, min_packets: int = 0,
               include_rtt: bool = False, snap: bool = True) -> DataFrame:
    """Raw features. With `include_rtt` the frame must hold raw gaps and an `rtt` column, which comes first.

    All features are active unless a model or the caller masks some.
    """
    active = _check(active)
    values: dict[str, Column] = {}
    if "timestamp" in active:
        values["t"] = F.col("t")
    if "size" in active:
        values["s"] = _signed(F.col("s"), F.col("d"), "direction" in active)
    rows = long_enough(features, min_packets)
    out = _wide(rows, ["conn_id", "rtt"] if include_rtt else ["conn_id"], num_packets, values, snap)
    return out.withColumn("rtt", snapped(F.col("rtt"))) if include_rtt and snap else out


def quantized_matrix(quantized: DataFrame, num_packets: int, active: Iterable[str], positions: int | None = None,
                     min_packets: int = 0) -> DataFrame:
    """Bins instead of values, from a frame with `sym` and the raw direction `d`.

    `positions` is the length of the quantizer; asking for more columns than that is an error up front.
    """
    active = _check(active)
    if positions is not None and positions < num_packets:
        raise ValueError(f"quantizer has {positions} positions, {num_packets} asked for")
    values: dict[str, Column] = {}
    if "timestamp" in active:
        values["t"] = F.col("sym.t")
    if "size" in active:
        values["s"] = _signed(F.col("sym.s"), F.col("d"), "direction" in active)
    return _wide(long_enough(quantized, min_packets), ["conn_id"], num_packets, values, snap=False)
