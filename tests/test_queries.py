"""Registered queries against their SQL on the smallest tables; all of them with SEQDRIFT_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from checks.run import compare, database

SF = "/root/testdata/sf0.001"
SOME = ["flow_build", "rtt_gaps", "preprocessed_flows", "discard_reasons", "stats_merge", "size_iqr", "maxdiff_contents",
        "quantize_global", "dequantize", "profile_with_time", "conditional_histogram", "kl_cumulative_order2", "generate_order1",
        "sample_rows", "export_min_packets", "tsv_logs", "probe_logs", "model_json", "stream_profile"]


@pytest.fixture(scope="module")
def tables():
    return database(SF)


def test_entry(spark):
    rows = entry.entry(spark).orderBy("idx").collect()
    assert [r["idx"] for r in rows[:3]] == [0, 1, 2]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SOME) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("SEQDRIFT_ALL") else SOME)
def test_against_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    cur = tables.execute(entry.oracle_sql()[name])
    assert compare((df.columns, [tuple(r) for r in df.collect()]), ([d[0] for d in cur.description], cur.fetchall())) == ""


def test_other_time_zone(spark, tables):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_against_sql(spark, tables, "flow_build")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
