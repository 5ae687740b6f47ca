"""General tables read as flows: user events, order lines, conversations, and packet events made of them.

Each function maps whole tables; nothing is cut or sampled. Order within a key is numbered with hot keys
cut into chunks (`operators.skew`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift.functions.numeric import seconds
from seqdrift.operators.flows import directional_gaps
from seqdrift.operators.skew import Cuts, chunk_rows, exclusive_sums, measure_cuts, number_rows

DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(df: DataFrame, column: str) -> Column:
    return seconds(column, dict(df.dtypes)[column])


def _forward(event_type: Column) -> Column:
    return event_type.isin("click", "purchase", "signup")


def _version(user: Column) -> Column:
    m = F.pmod(user, F.lit(4))
    return F.when(m == 0, F.lit("TLSv12")).when(m == 3, F.lit("unknown-64282")).otherwise(F.lit("TLSv13"))


def conn_id(user: Column) -> Column:
    return F.concat(F.lit("user-"), user.cast("string"))


def numbered_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Cuts]:
    """(conn_id, user_id, rn, ts, event_type, value) with rn from 0 in time order per user.

    The flow id is made before the first shuffle, so that later steps by flow find their rows in place.
    """
    raw = table(spark, sf_dir, "events")
    events = raw.select(conn_id(F.col("user_id")).alias("conn_id"), "user_id", "event_id", _epoch(raw, "ts").alias("ts"),
                        "event_type", "value")
    cuts = measure_cuts(events, "conn_id", "ts")
    return number_rows(events, "conn_id", [F.col("ts"), F.col("event_id")], cuts, "rn").drop("event_id"), cuts


def event_flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flow log and packet log of user events: three handshake events, then packets.

    The stated length of some flows is one too large, for the length check to find.
    """
    rows, _ = numbered_events(spark, sf_dir)
    user = F.col("user_id")

    def at(rn: int) -> Column:
        return F.max(F.when(F.col("rn") == rn, F.col("ts")))

    flows = rows.groupBy("conn_id").agg(
        at(0).alias("syn_ts"), at(1).alias("synack_ts"), at(2).alias("ack_ts"), F.min("user_id").alias("user_id"),
        F.greatest(F.count("*") - 3, F.lit(0)).alias("n"),
    )
    flows = flows.select(
        "conn_id", "syn_ts", "synack_ts", "ack_ts", _version(user).alias("version"),
        F.lit(0).alias("client_hello"), F.lit(1).alias("server_hello"),
        (F.lit(2) + F.pmod(user, F.lit(3))).cast("int").alias("ssl_est"),
        (F.col("n") + F.when(F.pmod(user, F.lit(11)) == 0, 1).otherwise(0)).alias("len"),
    )
    packets = rows.where(F.col("rn") >= 3).select(
        "conn_id", (F.col("rn") - 3).alias("idx"), "ts",
        _forward(F.col("event_type")).cast("int").alias("direction"), (F.floor("value") + 1).cast("int").alias("size"),
    )
    return flows, packets


def event_chunk(spark: SparkSession, sf_dir: str) -> int | None:
    """Chunk length for the flows of `event_flows`, or None when every flow is short enough for one task."""
    limit = chunk_rows(spark)
    return limit if table(spark, sf_dir, "events").count() > limit else None


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conn_id, side, idx, t, d, s) of order lines: many short flows without a handshake, gaps in days.

    One shuffle and one sort number the lines and find the gaps.
    """
    raw = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    lines = raw.select(
        key.cast("string").alias("conn_id"), _epoch(raw, "l_shipdate").alias("ts"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", F.when(key % 2 == 0, F.lit("P")).otherwise(F.lit("Q")).alias("side"),
        (F.col("l_linestatus") == "O").cast("int").alias("direction"),
        (F.floor(F.col("l_extendedprice") / 72) + 1).cast("int").alias("size"),
    )
    cuts = measure_cuts(lines, "conn_id", "ts")
    order = ("ts", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = number_rows(lines, "conn_id", [F.col(c) for c in order], cuts)
    chunk = None if cuts.table is None else chunk_rows(spark)
    # the gap replaces ts, so the sort goes by a copy of it
    gaps = directional_gaps(numbered.withColumn("at", F.col("ts")), F.lit(DAY), chunk, ("at", *order[1:]))
    return gaps.select("conn_id", "side", "idx", "t", F.col("direction").alias("d"), F.col("size").alias("s"))


def conversation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as packets; long messages lie outside the size domain."""
    rows = table(spark, sf_dir, "conversations")
    packets = rows.select(
        F.col("conv_id").cast("string").alias("conn_id"), F.col("turn").cast("int").alias("idx"), F.col("turn").cast("double").alias("ts"),
        (F.col("role") == "user").cast("int").alias("direction"), F.length("text").cast("int").alias("size"),
    )
    limit = chunk_rows(spark)
    chunk = limit if rows.count() > limit else None
    return directional_gaps(packets, None, chunk).select("conn_id", "idx", "t", F.col("direction").alias("d"), F.col("size").alias("s"))


def packet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet events with faults of every kind, made of user events (schema PACKET_EVENTS)."""
    rows, cuts = numbered_events(spark, sf_dir)
    user, rn = F.col("user_id"), F.col("rn")
    data = rn >= 3
    size = (F.floor("value") + 1).cast("long")
    rows = rows.select(
        "conn_id", "user_id", "rn", "ts",
        F.when(data & (rn > 3), _forward(F.col("event_type"))).otherwise(rn != 1).alias("is_orig"),
        F.when(data, size).otherwise(F.lit(0)).alias("len"),
    )
    rows = exclusive_sums(rows, ["conn_id", "is_orig"], [rn], {"seq": F.col("len")}, cuts)
    back = _previous_ts(rows) - 3600.0
    ts = F.when((F.pmod(user, F.lit(13)) == 0) & (rn == 30), back).otherwise(F.col("ts"))
    ssl_est = F.lit(5)
    first_bytes = (
        F.when((F.pmod(user, F.lit(19)) == 0) & (rn == 3), F.lit("000000"))
        .when(rn <= ssl_est, F.lit("160301")).otherwise(F.lit("170303"))
    )
    event = (
        F.when(rn == 3, F.lit("client_hello"))
        .when((rn == 4) & (F.pmod(user, F.lit(17)) != 0), F.lit("server_hello"))
        .when(rn == 5, F.lit("ssl_est"))
    )
    gap = F.when((F.pmod(user, F.lit(7)) == 0) & (rn >= 20), 1).otherwise(0)
    return rows.select(
        "conn_id", rn.cast("long").alias("arrival"), ts.alias("ts"), "is_orig",
        F.when(rn == 0, F.lit("S")).when(rn == 1, F.lit("SA")).when(rn == 2, F.lit("A")).otherwise(F.lit("PA")).alias("flags"),
        (F.col("seq") + gap).cast("long").alias("seq"), F.col("len").cast("long").alias("len"),
        F.when(data, F.unhex(first_bytes)).alias("payload_prefix"), event.alias("event"),
        F.when(rn == 5, _version(user)).alias("version"),
    )


def _previous_ts(rows: DataFrame) -> Column:
    """Time of row 29 of the same user. Only rows 29 and 30 take part, so a long key costs two rows."""
    from pyspark.sql import Window as W

    two = F.col("rn").isin(29, 30)
    # rows outside the pair are spread by their number and see no neighbour
    near = W.partitionBy("conn_id", F.when(two, F.lit(-1)).otherwise(F.col("rn"))).orderBy("rn")
    return F.lag("ts").over(near)
