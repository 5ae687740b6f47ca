"""The data source of paired logs against Spark's own reader of the same files."""

import gzip
import os
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from seqdrift.session import shared_dir
from seqdrift.sources import logs as L
from seqdrift.sources import pairs


def flow_text(k, n=3):
    head = "\t".join(f"column{i}" for i in range(9))
    return "\n".join([head, *(f"c{k}-{i}\t{i}.5\t{i}.6\t{i}.7\tTLSv13\t0\t1\t\t{i}" for i in range(n))]) + "\n"


def packet_text(k, n=7):
    return "\n".join(["\t".join("abcde"), *(f"c{k}-{i % 3}\t{i}\t{i}.25\t{i % 2}\t{i + 1}" for i in range(n))]) + "\n"


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    data = text.encode()
    if name.endswith(".gz"):
        data = gzip.compress(data)
    elif name.endswith(".zst"):
        data = zstandard.compress(data)
    (folder / name).write_bytes(data)


@pytest.fixture
def tree(tmp_path):
    for k, suffix in enumerate(("", ".gz", ".zst")):
        put(tmp_path / f"site{k}" / "tap", f"flows.log{suffix}", flow_text(k))
        put(tmp_path / f"site{k}" / "tap", f"packets.log{suffix}", packet_text(k))
    put(tmp_path / "two", "flows.a.log", flow_text(7)), put(tmp_path / "two", "flows.b.log", flow_text(7)), put(tmp_path / "two", "packets.log", packet_text(7))
    put(tmp_path / "none", "flows.log", flow_text(8))
    put(tmp_path / "site0", "flows.log", flow_text(9)), put(tmp_path / "site0", "packets.log", packet_text(9))  # has a folder below
    put(tmp_path / "empty", "flows.log", ""), put(tmp_path / "empty", "packets.log", "only\ta\theader\tin\tit\n")
    return tmp_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_the_text_reader(spark, tree):
    pairs.register(spark)
    listed = L.paired_logs(L.files_below(spark, str(tree))).where("dir not like '%/empty'").collect()
    assert len(listed) == 3
    for table, read, name in (("flows", L.flow_log, "flow_log"), ("packets", L.packet_log, "packet_log")):
        got = spark.read.format("paired_logs").option("table", table).load(str(tree))
        assert rows(got.drop("dir")) == rows(read(spark, [f"{r['dir']}/{r[name]}" for r in listed]))
        assert {r[0] for r in got.select("dir").distinct().collect()} == {f"{tree}/site{k}/tap" for k in range(3)}
    uri = spark.read.format("paired_logs").option("table", "packets").load(f"file://{tree}")
    assert uri.count() == 21


def test_filters_choose_partitions(spark, tree):
    pairs.register(spark)
    got = spark.read.format("paired_logs").option("table", "packets").load(str(tree))
    assert got.rdd.getNumPartitions() == 4
    for condition, n in ((F.col("dir") == f"{tree}/site1/tap", 1), (F.col("dir").isin(f"{tree}/site1/tap", f"{tree}/site2/tap"), 2),
                         (F.col("dir").startswith(f"{tree}/site"), 3)):
        some = got.where(condition & (F.col("size") > 3))
        assert some.rdd.getNumPartitions() == n and some.count() == n * 4


def test_bad_numbers_and_options(spark, tmp_path):
    pairs.register(spark)
    put(tmp_path / "a", "flows.log", flow_text(1)), put(tmp_path / "a", "packets.log", packet_text(1) + "c\tx\t1\t1\t1\n")
    with pytest.raises(Exception, match="(?s)conversion error|CSV"):
        spark.read.format("paired_logs").option("table", "packets").load(str(tmp_path)).collect()
    assert spark.read.format("paired_logs").load(str(tmp_path)).count() == 3
    with pytest.raises(Exception, match="table is one of"):
        spark.read.format("paired_logs").option("table", "other").load(str(tmp_path)).schema  # noqa: B018


def test_stream_takes_new_pairs_once(spark, tree):
    pairs.register(spark)
    out = shared_dir(spark, "pairs")

    def go_on():
        stream = spark.readStream.format("paired_logs").option("table", "packets").option("settle", "30").load(str(tree))
        run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").start()
        run.processAllAvailable()
        run.stop()

    old = time.time() - 100
    for root, _, files in os.walk(tree):
        for f in files:
            os.utime(os.path.join(root, f), (old, old))
    go_on()
    assert spark.read.parquet(f"{out}/rows").count() == 21
    put(tree / "site9", "flows.log", flow_text(9)), put(tree / "site9", "packets.log.zst", packet_text(9, 10))
    go_on()  # the new pair is not settled yet
    assert spark.read.parquet(f"{out}/rows").count() == 21
    for f in os.listdir(tree / "site9"):
        os.utime(tree / "site9" / f, (old + 50, old + 50))
    go_on()
    go_on()
    got = spark.read.parquet(f"{out}/rows")
    assert got.count() == 31 and got.where(f"dir = '{tree}/site9'").count() == 10


def test_written_pairs_read_back(spark, tmp_path):
    pairs.register(spark)
    flows = spark.createDataFrame([(f"c{i}", i + 0.1, i + 0.2, None, "TLSv12", 0, 1, 2, 3) for i in range(40)], pairs.FLOW_LOG)
    packets = spark.createDataFrame([(f"c{i % 40}", i, i * 0.5, i % 2, i) for i in range(300)], pairs.PACKET_LOG)
    done = pairs.write_pairs(flows, packets, str(tmp_path), 5)
    assert done.count() == 5 and done.agg(F.sum("packets")).first()[0] == 300
    for table, df in (("flows", flows), ("packets", packets)):
        assert rows(spark.read.format("paired_logs").option("table", table).load(str(tmp_path)).drop("dir")) == rows(df)
