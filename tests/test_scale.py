"""Parts of a job grow in number, not in size, with its input."""

import os

import pytest

from checks.catalog import QUERIES
from seqdrift.sources import artifacts as AR
from seqdrift.sources import pairs as PL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
@pytest.mark.parametrize("name", ["stream_latest_flow_rows", "stream_discard_reasons"])
def test_no_part_of_a_stream_is_written_by_one_task(spark, monkeypatch, name):
    def coalesce(self, n):
        raise AssertionError(f"{n} tasks read a whole table")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", coalesce)
    assert QUERIES[name](spark, SF).count() > 0


def test_buckets_and_pairs_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(AR, "BUCKET_ROWS", 10)
    assert AR.buckets_for(spark.range(20)) == 8
    assert AR.buckets_for(spark.range(101)) == 11
    assert PL.pairs_for(0) == PL.pairs_for(2_000_000) == 8
    assert PL.pairs_for(36_000_000) == 144


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
@pytest.mark.parametrize("name, module, constant, writer", [("bucketed_profile_order1", AR, "BUCKET_ROWS", "save_bucketed"),
                                                            ("paired_log_stream", PL, "PAIR_ROWS", "write_pairs")])
def test_queries_ask_for_as_many_parts_as_rows_need(spark, monkeypatch, name, module, constant, writer):
    parts, write = [], getattr(module, writer)
    monkeypatch.setattr(module, constant, 50)
    monkeypatch.setattr(module, writer, lambda flows, packets, path, n: parts.append(n) or write(flows, packets, path, n))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        QUERIES[name](spark, SF).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert parts[0] > 8
