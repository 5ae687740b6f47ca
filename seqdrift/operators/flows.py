"""From flow and packet tables to normalised features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.functions.numeric import rtt
from seqdrift.functions.predicates import everything, normal_version
from seqdrift.operators.skew import chunk_rows, previous_by_direction


def latest_flows(flow_log: DataFrame, file_order: Column | None = None) -> DataFrame:
    """One row per conn_id: a later row replaces an earlier one.

    A grouped maximum rather than a window, so many copies of one id are reduced before the shuffle.
    """
    order = F.lit(0) if file_order is None else file_order
    columns = [c for c in flow_log.columns if c != "conn_id"]
    newest = flow_log.groupBy("conn_id").agg(F.max_by(F.struct(*columns), order).alias("_f"))
    return newest.select("conn_id", *[F.col("_f")[c].alias(c) for c in columns])


def complete_flows(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """Flows whose stated length equals their number of packets; length 0 without packets is complete."""
    counted = packets.groupBy("conn_id").agg(F.count("*").alias("_n"))
    return (
        flows.join(counted, "conn_id", "left")
        .where(F.col("len") == F.coalesce(F.col("_n"), F.lit(0)))
        .drop("_n")
    )


def build_flows(flow_log: DataFrame, packet_log: DataFrame, file_order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Complete flows, versions normalised, and their packets; packets of unknown flows are dropped."""
    flows = latest_flows(flow_log, file_order).withColumn("version", normal_version(F.col("version")))
    flows = complete_flows(flows, packet_log)
    return flows, packet_log.join(flows.select("conn_id"), "conn_id", "left_semi")


def with_rtt(flows: DataFrame) -> DataFrame:
    return flows.withColumn("rtt", rtt(F.col("syn_ts"), F.col("synack_ts"), F.col("ack_ts")))


def usable_rtt(flows: DataFrame) -> DataFrame:
    """Flows with a positive round trip: those that have normalised gaps."""
    return flows.where(F.col("rtt") > 0)


def unusable_rtt_count(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count_if(~F.coalesce(F.col("rtt") > 0, F.lit(False))).alias("flows_without_rtt"))


def strip_handshake(packets: DataFrame) -> DataFrame:
    """Drops packets up to `ssl_est` and restarts positions at 0; raw flows (null) stay as they are."""
    shift = F.coalesce(F.col("ssl_est") + 1, F.lit(0))
    return packets.where(F.col("idx") >= shift).withColumn("idx", (F.col("idx") - shift).cast("int"))


def strip_flows(flows: DataFrame) -> DataFrame:
    """The flow side of stripping: shorter, and without protocol facts afterwards."""
    out = flows.withColumn("len", F.greatest(F.col("len") - F.coalesce(F.col("ssl_est") + 1, F.lit(0)), F.lit(0)))
    for c, kind in flows.dtypes:
        if c in ("version", "client_hello", "server_hello", "ssl_est"):
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out


def chunk_for(flows: DataFrame) -> int | None:
    """Chunk length for `preprocess`, or None when no flow is longer than one task should order.

    Reads stated lengths only, a filter that reaches the file scan; use it on complete flows.
    """
    limit = chunk_rows(flows.sparkSession)
    return None if flows.where(F.col("len") > limit).isEmpty() else limit


def directional_gaps(packets: DataFrame, scale: Column | None = None, chunk: int | None = None,
                     order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Replaces `ts` by `t`: time since the previous packet of the same direction, 0 for the first one.

    With `scale` (the round trip) gaps are in round trips, without it in seconds.
    """
    out = previous_by_direction(packets, "conn_id", "ts", F.col("direction") > 0.5, chunk, order)
    gap = F.coalesce(F.col("ts") - F.col("prev"), F.lit(0.0))
    return out.withColumn("t", gap if scale is None else gap / scale).drop("prev", "ts")


def preprocess(flows: DataFrame, packets: DataFrame, keep: Column | None = None, strip: bool = False,
               normalise: bool = True, chunk: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Filter, strip, normalise, in that order: the feature frame (conn_id, idx, t, d, s).

    The filter runs on the flow table before any packet is shuffled. `carry` names flow columns to keep. A flow
    without a positive round trip has a null time, its directions and sizes stay.
    """
    chosen = flows.where(everything() if keep is None else keep)
    chosen = with_rtt(chosen)
    side = chosen.select("conn_id", "rtt", "ssl_est", *carry)
    joined = packets.join(side, "conn_id")
    if strip:
        joined = strip_handshake(joined)
    gaps = directional_gaps(joined, F.when(F.col("rtt") > 0, F.col("rtt")) if normalise else None, chunk)
    return gaps.select("conn_id", *carry, *([] if normalise else ["rtt"]), "idx", "t",
                       F.col("direction").alias("d"), F.col("size").alias("s"))


def long_features(features: DataFrame) -> DataFrame:
    """One row per feature value: (conn_id, idx, feature, value)."""
    return features.select(
        "conn_id", "idx",
        F.expr("stack(3, 'timestamp', double(t), 'direction', double(d), 'size', double(s)) as (feature, value)"),
    )
