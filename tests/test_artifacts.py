"""Logs, models and matrices on disk."""

import gzip
import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from seqdrift.functions import quantizing as Q
from seqdrift.operators import export as E
from seqdrift.operators import flows as FL
from seqdrift.operators import quantize as QZ
from seqdrift.operators.quantize import Quantizer
from seqdrift.sources import artifacts as AR
from seqdrift.sources import logs as L

FLOWS = "conn_id\tsyn_ts\tsynack_ts\tack_ts\tversion\tclient_hello\tserver_hello\tssl_est\tlen\n"
PACKETS = "conn_id\tidx\ttimestamp\tdirection\tsize\n"


def test_text_logs(spark, tmp_path):
    (tmp_path / "flows.log").write_text(FLOWS + 'C"1\t1.0\t1.5\t2.0\tTLSv13\t0\t1\t2\t2\nC2\t1\t2\t3\tDTLS\t0\t1\t2\t3\nC3\t1\t2\t3\tSSL\t0\t1\t2\t0\n')
    with gzip.open(tmp_path / "packets.log.gz", "wt") as f:
        f.write(PACKETS + 'C"1\t0\t2.5\t1\t100\nC"1\t1\t2.75\t0\t1460\n')
    (tmp_path / "packets.log.zst").write_bytes(zstandard.compress((PACKETS + "C2\t0\t2.5\t1\t100\nnobody\t0\t1\t1\t1\n").encode()))
    flows = L.flow_log(spark, str(tmp_path / "flows.log"))
    packets = L.packet_log(spark, [str(tmp_path / "packets.log.gz"), str(tmp_path / "packets.log.zst")])
    complete, kept = FL.build_flows(flows, packets)
    # C2 misses packets; a flow of length 0 without packets is complete
    assert {r["conn_id"]: r["version"] for r in complete.collect()} == {'C"1': "TLSv13", "C3": "SSL"}
    assert [(r["idx"], r["size"]) for r in kept.orderBy("idx").collect()] == [(0, 100), (1, 1460)]
    assert FL.latest_flows(flows).where("conn_id = 'C2'").first()["version"] == "DTLS"


def test_bad_numbers(spark, tmp_path):
    (tmp_path / "p.log").write_text(PACKETS + "C1\t0\tsoon\t1\t100\nC1\t1\t2.5\t1\t7\n")
    with pytest.raises(Exception):
        L.packet_log(spark, str(tmp_path / "p.log")).collect()
    rows = L.packet_log(spark, str(tmp_path / "p.log"), mode="PERMISSIVE").collect()
    assert [r["_bad"] is None for r in rows] == [False, True]


def test_empty_packet_log(spark, tmp_path):
    (tmp_path / "f.log").write_text(FLOWS + "C1\t1\t2\t3\tSSL\t0\t1\t2\t1\n")
    (tmp_path / "p.log").write_text(PACKETS)
    flows, packets = FL.build_flows(L.flow_log(spark, str(tmp_path / "f.log")), L.packet_log(spark, str(tmp_path / "p.log")))
    assert (flows.count(), packets.count()) == (0, 0)


def test_finding_logs(spark, tmp_path):
    def touch(*parts):
        p = tmp_path.joinpath(*parts)
        os.makedirs(p.parent, exist_ok=True)
        p.write_text("x")

    touch("a", "connections.log"), touch("a", "packets.log.gz")
    touch("b", "connections.log"), touch("b", "deeper", "connections.1.log"), touch("b", "packets.log"), touch("b", "deeper", "packets.1.log")
    touch("c", "connections.log"), touch("c", "connections.2.log"), touch("c", "packets.log")
    touch("d", "flows.parquet", "part-0"), touch("d", "flows.parquet", "part-1"), touch("e", "flows-2.parquet")
    files = L.files_below(spark, str(tmp_path))
    assert sorted(r["dir"].rsplit("/", 1)[1] for r in L.paired_logs(files, flow_name=r"^connections.*\.log").collect()) == ["a", "deeper"]
    assert sorted((r["dir"].rsplit("/", 1)[1], r["name"]) for r in L.shards(files).collect()) == [("d", "flows.parquet"), ("e", "flows-2.parquet")]


def test_probe_logs(spark, tmp_path):
    one = {"proxy": "p", "domain": "d", "ok": True, "status": 200, "error": None, "startedAt": "2024-01-01T00:00:00.000Z",
           "finishedAt": "2024-01-01T00:00:02.500Z", "tlsVersion": "1.3", "postQuantum": "on"}
    (tmp_path / "a.json").write_text(json.dumps([dict(one, url="https://d", proxyServer="s"), dict(one, ok=False, status=None, error="x", url="u", proxyServer="s")], indent=2))
    (tmp_path / "l.jsonl").write_text(json.dumps(one) + "\n" + json.dumps(one) + "\n")
    rows = L.probe_log(spark, str(tmp_path / "a.json"), str(tmp_path / "l.jsonl"))
    assert rows.count() == 4
    assert rows.where("url is null").count() == 2
    assert rows.select(F.sum(F.col("finishedAt").cast("double") - F.col("startedAt").cast("double"))).first()[0] == pytest.approx(10.0)


MODEL = {
    "markov_order": 1,
    "quantizer": {"PerPacket": [
        {"timestamp": {"feature": {"feature": "Timestamp", "effective_min": 0.0, "effective_max": 1.7976931348623157e308}, "quantization": "Mask"},
         "direction": {"feature": {"feature": "Direction", "effective_min": 0.0, "effective_max": 2.0}, "quantization": "Identity"},
         "size": {"feature": {"feature": "Size", "effective_min": 1.0, "effective_max": 1461.0},
                  "quantization": {"Empirical": {"lookup": [0, 1, 1, 2, 2, 2, 3],
                                                 "bins": [{"values": [1], "counts": [31]}, {"values": [2, 3], "counts": [58, 17]},
                                                          {"values": [4, 5, 6], "counts": [9, 4, 22]}, {"values": [], "counts": []}]}}}},
        {"timestamp": {"feature": {"feature": "Timestamp", "effective_min": 0.0, "effective_max": 15.0}, "quantization": {"LogUniform": {"inv_log_width": 1.4426950408889634}}},
         "direction": {"feature": {"feature": "Direction", "effective_min": 0.0, "effective_max": 2.0}, "quantization": "Mask"},
         "size": {"feature": {"feature": "Size", "effective_min": 1.0, "effective_max": 1461.0}, "quantization": {"Uniform": {"inv_width": 0.0273972602739726}}}},
    ]},
}


def test_model_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MODEL, indent=2))
    order, kind, table = AR.read_model(spark, str(tmp_path / "m.json"))
    assert (order, kind) == (1, "PerPacket")
    counts = [tuple(r) for r in QZ.bin_counts(table).orderBy("idx").collect()]
    assert counts == [(0, 1, 2, 4, 8, 2), (1, 4, 1, 40, 160, 2)]
    AR.write_model(table, order, str(tmp_path / "again"))
    again = AR.read_model(spark, str(tmp_path / "again"))
    assert again[0] == 1
    assert sorted(map(str, again[2].collect())) == sorted(map(str, table.collect()))
    assert QZ.min_features(table, 1).first()[0] == 2
    with pytest.raises(Exception, match="too short"):
        QZ.min_features(table, 2).collect()
    AR.save_quantizer(table, str(tmp_path / "q"))
    assert AR.load_quantizer(spark, str(tmp_path / "q")).count() == 2


def test_global_model(spark, tmp_path):
    document = {"markov_order": 0, "quantizer": {"Global": MODEL["quantizer"]["PerPacket"][0]}}
    document["quantizer"]["Global"]["timestamp"]["feature"]["effective_max"] = None
    (tmp_path / "g.json").write_text(json.dumps(document))
    order, kind, table = AR.read_model(spark, str(tmp_path / "g.json"))
    assert (order, kind) == (0, "Global")
    features = spark.createDataFrame([("c", i, 1.0, i % 2, i % 6 + 1) for i in range(12)], "conn_id string, idx int, t double, d int, s int")
    got = QZ.symbols(features, Quantizer.everywhere(table.first())).orderBy("idx").collect()
    assert [r["sym"]["s"] for r in got] == [0, 1, 1, 2, 2, 2] * 2
    drawn = QZ.dequantized(spark.createDataFrame([("c", i, (-1, 1, i % 3)) for i in range(300)], "conn_id string, idx int, sym struct<t:int,d:int,s:int>"),
                           Quantizer.everywhere(table.first()), 1)
    sizes = {i: {r["s"] for r in drawn.where(F.col("idx") % 3 == i).collect()} for i in range(3)}
    assert sizes == {0: {1.0}, 1: {2.0, 3.0}, 2: {4.0, 5.0, 6.0}}


def test_csv(spark, tmp_path):
    features = spark.createDataFrame([("a", 0, 0.5, 1, 7), ("a", 1, 2.0000000000001, 0, 9), ("b", 0, 0.0, 0, 3)], "conn_id string, idx int, t double, d int, s int")
    AR.write_matrix(E.raw_matrix(features, 2).coalesce(1), str(tmp_path / "out"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["0,-3,-1,-1", "0.5,7,2,-9"]
    with pytest.raises(ValueError, match="positions"):
        E.quantized_matrix(features.withColumn("sym", F.struct(F.lit(-1).alias("t"), F.lit(0).alias("d"), F.lit(0).alias("s"))), 3, ("size",), positions=2)


def test_identity_and_masks_in_draws(spark):
    row = spark.range(1).select(Q.mask("timestamp").alias("t"), Q.mask("direction").alias("d"), Q.mask("size").alias("s")).first()
    drawn = QZ.dequantized(spark.createDataFrame([("c", i, (-1, -1, -1)) for i in range(500)], "conn_id string, idx int, sym struct<t:int,d:int,s:int>"), Quantizer.everywhere(row), 1)
    low = drawn.agg(F.min("s"), F.max("s"), F.min("d"), F.max("d")).first()
    assert low[0] >= 1 and low[1] <= 1460 and low[2] == 0 and low[3] == 1
    assert QZ.domain_guard(drawn, "drop").count() == 500
