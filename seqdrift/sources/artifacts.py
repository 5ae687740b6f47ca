"""Saved results: flow tables, statistics, profiles and divergences as Parquet; models as Parquet or JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift.functions import quantizing as Q
from seqdrift.schema import FLOW_LOG, PACKET_LOG, QUANTIZER, SHORT

_FEATURE_JSON = "struct<feature:struct<feature:string,effective_min:double,effective_max:double>,quantization:string>"
_PACKET_JSON = ",".join(f"{name}:{_FEATURE_JSON}" for name in SHORT)
_MODEL_JSON = f"markov_order int, quantizer struct<Global:struct<{_PACKET_JSON}>,PerPacket:array<struct<{_PACKET_JSON}>>>"
_KIND_JSON = (
    "Uniform struct<inv_width:double>, LogUniform struct<inv_log_width:double>, "
    "Empirical struct<lookup:array<int>,bins:array<struct<values:array<int>,counts:array<bigint>>>>"
)


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """Any artifact as Parquet; histograms are kept by profile (`by="profile"`)."""
    writer = df.write
    (writer.partitionBy(by) if by else writer).parquet(path)


def load(spark: SparkSession, paths: str | list[str], schema=None) -> DataFrame:
    """One artifact, or any number of shards read as one table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def save_flows(flows: DataFrame, packets: DataFrame, path: str) -> None:
    save(flows, f"{path}/flows")
    save(packets, f"{path}/packets")


def load_flows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, f"{path}/flows", FLOW_LOG), load(spark, f"{path}/packets", PACKET_LOG)


#: packets of a bucket that a task sorts and joins
BUCKET_ROWS = 1_000_000


def buckets_for(packets: DataFrame, least: int = 8) -> int:
    """Buckets for a packet table, so that their size stays the same however large the table is."""
    return max(least, -(-packets.count() // BUCKET_ROWS))


def save_bucketed(flows: DataFrame, packets: DataFrame, path: str, buckets: int) -> None:
    """Flows and packets in files by hash of conn_id, packets of a bucket sorted by flow and position: one shuffle here, none later."""
    name = f"seqdrift_{uuid.uuid4().hex}"
    for table, df, order in (("flows", flows, ["conn_id"]), ("packets", packets, ["conn_id", "idx"])):
        # one task per bucket, so one file each
        dealt = df.repartition(buckets, "conn_id").sortWithinPartitions(*order)
        writer = dealt.write.format("parquet").bucketBy(buckets, "conn_id").sortBy(*order).option("path", f"{path}/{table}")
        writer.mode("errorifexists").saveAsTable(f"{name}_{table}")
        df.sparkSession.sql(f"drop table {name}_{table}")  # the name, not the files


def load_bucketed(spark: SparkSession, path: str, buckets: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Tables written by `save_bucketed`, named `name`_flows and `name`_packets in the session's catalog.

    Joins and windows by conn_id read them without an exchange, as long as both sides have the same number of buckets."""
    for table, order in (("flows", "conn_id"), ("packets", "conn_id, idx")):
        schema = spark.read.parquet(f"{path}/{table}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"create table if not exists {name}_{table} ({columns}) using parquet clustered by (conn_id) sorted by ({order}) "
                  f"into {buckets} buckets location '{path}/{table}'")
    return spark.table(f"{name}_flows"), spark.table(f"{name}_packets")


def _feature_from_json(feature: str, part: Column) -> Column:
    text = part["quantization"]
    body = F.when(text.startswith("{"), F.from_json(text, _KIND_JSON))
    kind = (
        F.when(text == "Mask", F.lit("mask")).when(text == "Identity", F.lit("identity"))
        .when(body["Empirical"].isNotNull(), F.lit("empirical"))
        .when(body["LogUniform"].isNotNull(), F.lit("loguniform"))
        .when(body["Uniform"].isNotNull(), F.lit("uniform"))
        .otherwise(F.raise_error(F.lit(f"unknown quantization of {feature}")))
    )
    # an infinite bound is written as null
    lo, hi = part["feature"]["effective_min"], F.coalesce(part["feature"]["effective_max"], F.lit(float("inf")))
    inv = F.coalesce(body["Uniform"]["inv_width"], body["LogUniform"]["inv_log_width"])
    bins = body["Empirical"]["bins"]
    count = F.when(bins.isNotNull(), F.size(bins).cast("long")).otherwise(Q.count_bins(kind, lo, hi, inv))
    return Q.make(kind, lo, hi, inv, count, body["Empirical"]["lookup"], bins)


def read_model(spark: SparkSession, path: str) -> tuple[int, str, DataFrame]:
    """A JSON model: (markov_order, "Global" or "PerPacket", quantizer table).

    A global quantizer comes as one row at position 0. The order and the kind are read at once; they are
    two values of one document.
    """
    document = spark.read.text(path, wholetext=True).select(F.from_json("value", _MODEL_JSON, {"mode": "FAILFAST"}).alias("m"))
    order, is_global = document.select("m.markov_order", F.col("m.quantizer.Global").isNotNull()).first()
    if is_global:
        rows = document.select(F.lit(0).alias("idx"), F.col("m.quantizer.Global").alias("p"))
    else:
        rows = document.select(F.posexplode("m.quantizer.PerPacket").alias("idx", "p"))
    table = rows.select("idx", *[_feature_from_json(f, F.col("p")[f]).alias(c) for f, c in SHORT.items()])
    return order, "Global" if is_global else "PerPacket", table


def _feature_to_json(feature: str, q: Column) -> Column:
    def number(x: Column) -> Column:
        return F.when(x == float("inf"), F.lit("null")).otherwise(x.cast("string"))

    head = F.concat(F.lit('{"feature":{"feature":"' + feature.capitalize() + '","effective_min":'), number(q["eff_min"]),
                    F.lit(',"effective_max":'), number(q["eff_max"]), F.lit('},"quantization":'))
    body = (
        F.when(q["kind"] == "mask", F.lit('"Mask"')).when(q["kind"] == "identity", F.lit('"Identity"'))
        .when(q["kind"] == "uniform", F.concat(F.lit('{"Uniform":{"inv_width":'), number(q["inv_width"]), F.lit("}}")))
        .when(q["kind"] == "loguniform", F.concat(F.lit('{"LogUniform":{"inv_log_width":'), number(q["inv_width"]), F.lit("}}")))
        .otherwise(F.concat(F.lit('{"Empirical":'), F.to_json(F.struct(q["lookup"].alias("lookup"), q["bins"].alias("bins"))), F.lit("}")))
    )
    return F.concat(head, body, F.lit("}"))


def write_model(quantizer: DataFrame, order: int, path: str) -> None:
    """A per-position quantizer as one JSON document. It holds positions x 1460 numbers and is one file."""
    parts = [F.concat(F.lit(f'"{f}":'), _feature_to_json(f, F.col(c))) for f, c in SHORT.items()]
    packet = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    rows = quantizer.groupBy().agg(F.sort_array(F.collect_list(F.struct("idx", packet.alias("p")))).alias("r"))
    text = F.concat(F.lit(f'{{"markov_order":{order},"quantizer":{{"PerPacket":['),
                    F.concat_ws(",", F.transform("r", lambda x: x["p"])), F.lit("]}}"))
    rows.select(text.alias("value")).coalesce(1).write.text(path)


def save_quantizer(quantizer: DataFrame, path: str) -> None:
    save(quantizer, path)


def load_quantizer(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, QUANTIZER)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A wide matrix as CSV without a header and without the id: one row per flow.

    Whole numbers are written without a decimal point.
    """
    columns = []
    for c in matrix.columns:
        if c == "conn_id":
            continue
        x = F.col(c)
        whole = (x == F.round(x)) & (F.abs(x) < 9e15)
        columns.append(F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string")).alias(c))
    matrix.select(*columns).write.option("header", False).csv(path)
