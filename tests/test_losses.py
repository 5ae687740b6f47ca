"""Rows that are easy to lose without noticing: flows without packets or round trip, thin positions, long sequences."""

import pytest
from pyspark.sql import functions as F

from seqdrift.operators import fit as FT
from seqdrift.operators import flows as FL
from seqdrift.operators import generate as G
from seqdrift.operators import stats as S
from seqdrift.plans.export import export_flows

FLOW = "conn_id string, syn_ts double, synack_ts double, ack_ts double, version string, client_hello int, server_hello int, ssl_est int, len int"
PACKET = "conn_id string, idx int, ts double, direction int, size int"


@pytest.fixture(scope="module")
def tables(spark):
    flows = spark.createDataFrame(
        [("whole", 0.0, 1.0, 2.0, "TLSv13", 0, 1, 1, 4), ("short", 0.0, 1.0, 2.0, "TLSv13", 0, 1, 1, 2), ("flat", 5.0, 5.0, 5.0, "TLSv13", 0, 1, 1, 3)], FLOW)
    packets = spark.createDataFrame([(c, i, 10.0 + i, i % 2, 100 + i) for c, n in (("whole", 4), ("short", 2), ("flat", 3)) for i in range(n)], PACKET)
    return flows, packets


@pytest.mark.parametrize("options, ids", [
    ({"strip": True}, {"whole", "short"}),
    ({"strip": True, "skip_timing": True}, {"whole", "short", "flat"}),
    ({"strip": True, "include_rtt": True}, {"whole", "short", "flat"}),
    ({"strip": True, "skip_timing": True, "min_packets": 2}, {"whole"}),
    ({"strip": True, "skip_timing": True, "rows": 3}, {"whole", "short", "flat"}),
])
def test_a_matrix_row_for_every_chosen_flow(tables, options, ids):
    rows = {r["conn_id"]: r.asDict() for r in export_flows(*tables, 2, **options).collect()}
    assert set(rows) == ids
    if "short" in rows:
        assert {v for k, v in rows["short"].items() if k not in ("conn_id", "rtt")} == {-1.0}


def test_flows_without_round_trip_keep_directions_and_sizes(tables):
    rows = FL.preprocess(*tables).where("conn_id = 'flat'").collect()
    assert len(rows) == 3 and all(r["t"] is None and r["s"] >= 100 for r in rows)


def test_chunks_of_a_hot_flow_are_dealt_out(spark, tables):
    flows, packets = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FL.preprocess(flows, packets, chunk=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("hashpartitioning(conn_id" in line and "_chunk" in line for line in plan.split("\n"))


def test_thin_positions_are_an_error_or_counted(spark):
    counts = spark.createDataFrame([(0, 5000), (1, 100), (2, 5000), (3, 5000)], "idx int, n long")
    with pytest.raises(Exception, match="position 1"):
        FT.cut_positions(counts, 0.05, 0.05).collect()
    kept = FT.cut_positions(counts, 0.05, 0.05, strict=False)
    assert [r["idx"] for r in kept.collect()] == [0]
    assert tuple(FT.left_out(counts, kept).first()) == (3, 10100)
    assert FT.cut_positions(counts.where("idx != 1"), 0.05, 0.05).count() == 3


def test_profiles_too_short_or_of_another_order(spark):
    hist = spark.createDataFrame([(0, [], (-1, 0, 1), 3), (1, [(-1, 0, 1)], (-1, 0, 2), 3)],
                                 "idx int, ctx array<struct<t:int,d:int,s:int>>, sym struct<t:int,d:int,s:int>, cnt long")
    for order, length in ((1, 3), (0, 2)):
        with pytest.raises(ValueError):
            G.check_profile(hist, order, length)
    G.check_profile(hist, 1, 2)
    with pytest.raises(ValueError):
        G.generate_order0(hist.where("idx = 0"), 5, 2, 1)


@pytest.mark.parametrize("limit", [10, 1000])
def test_quantiles_ignore_nulls_at_any_size(spark, limit):
    rows = spark.createDataFrame([("c", 0, None if i % 3 == 0 else float(i)) for i in range(40)], "conn_id string, idx int, t double")
    got = S.exact_quantiles(rows, columns=("t",), limit=limit).first()
    assert (got["q01"], got["q50"]) == pytest.approx((1.25, 19.5))


def test_a_null_time_is_not_carried_between_chunks(spark):
    rows = spark.createDataFrame([("c", i, None if i == 3 else float(i), 1, 7) for i in range(6)], PACKET)
    whole = FL.directional_gaps(rows).orderBy("idx").collect()
    cut = FL.directional_gaps(rows, chunk=2).orderBy("idx").collect()
    assert [r["t"] for r in whole] == [r["t"] for r in cut]
