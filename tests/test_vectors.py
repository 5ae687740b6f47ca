"""Vectors worked out by hand from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from seqdrift.functions import numeric as N
from seqdrift.functions import predicates as PR
from seqdrift.functions import quantizing as Q
from seqdrift.operators import divergence as D
from seqdrift.operators import fit as FT
from seqdrift.operators import flows as FL
from seqdrift.operators import profile as P
from seqdrift.operators import quantize as QZ
from seqdrift.operators import stats as S
from seqdrift.operators.quantize import Quantizer

PACKETS = [(10.06, 1, 517), (10.09, 0, 1460), (10.10, 0, 1200), (10.12, 1, 80), (10.13, 1, 300), (10.18, 0, 900)]


@pytest.fixture(scope="module")
def one_flow(spark):
    flows = spark.createDataFrame(
        [("c", 10.00, 10.02, 10.05, "TLSv13", 0, 1, 2, 6)],
        "conn_id string, syn_ts double, synack_ts double, ack_ts double, version string, client_hello int, server_hello int, ssl_est int, len bigint")
    packets = spark.createDataFrame([("c", i, *p) for i, p in enumerate(PACKETS)], "conn_id string, idx int, ts double, direction int, size int")
    return flows, packets


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_gaps(one_flow):
    got = [r[0] for r in values(FL.preprocess(*one_flow).select("t", "idx"), "idx")]
    assert got == pytest.approx([0, 0, 0.2, 1.2, 0.2, 1.6])
    got = [r[0] for r in values(FL.preprocess(*one_flow, strip=True).select("t", "idx"), "idx")]
    assert got == pytest.approx([0, 0.2, 0])
    raw = FL.preprocess(*one_flow, normalise=False)
    assert raw.first()["rtt"] == pytest.approx(0.05)


def test_filters(one_flow):
    flows, _ = one_flow
    assert flows.where(PR.min_data_packets(3)).count() == 1
    assert flows.where(PR.min_data_packets(4)).count() == 0
    # all terms of a conjunction count, not the first two only
    assert flows.where(PR.min_data_packets(1) & PR.version_is("TLSv13") & PR.min_data_packets(4)).count() == 0
    raw = FL.strip_flows(flows)
    assert raw.first()["len"] == 3
    assert raw.where(PR.min_data_packets(100)).count() == 1
    assert raw.where(PR.version_is("TLSv13")).count() == 0
    # shorter than its handshake: fails, does not wrap around
    assert flows.withColumn("len", F.lit(1)).where(PR.min_data_packets(1)).count() == 0
    with pytest.raises(ValueError):
        PR.version_is("SSL")


FREQ = [(0, 1, 10), (0, 2, 10), (0, 3, 50), (0, 4, 48), (0, 6, 5)]


@pytest.mark.parametrize("bins,starts", [(1, []), (2, [4]), (3, [2, 4]), (4, [2, 4, 5]), (5, [2, 4, 5, 6])])
def test_maxdiff(spark, bins, starts):
    freq = spark.createDataFrame(FREQ, "idx int, value int, freq bigint")
    plan = spark.createDataFrame([(0, bins)], "idx int, size_bins bigint")
    assigned = FT.maxdiff(freq, plan)
    lookup = [r["bin"] for r in assigned.orderBy("value").collect()]
    assert len(lookup) == 1460
    assert [i for i in range(1, 1460) if lookup[i] != lookup[i - 1]] == starts
    if bins == 3:
        row = FT.maxdiff_tables(assigned).first()
        assert row["lookup"] == lookup
        assert [(b["values"], b["counts"]) for b in row["bins"]] == [([1, 2], [10, 10]), ([3, 4], [50, 48]), ([6], [5])]


def test_frequency_iqr(spark):
    freq = spark.createDataFrame(FREQ, "idx int, value int, freq bigint")
    row = S.frequency_iqr(freq, spark.createDataFrame([(0, 123)], "idx int, cnt bigint")).first()
    assert (row["q1"], row["q3"], row["iqr"]) == (3, 4, 1.0)
    lo, hi = Q.bounds("size")
    assert spark.range(1).select(N.freedman_diaconis(lo, hi, F.lit(123), F.lit(1.0))).first()[0] == 3631
    assert spark.range(1).select(N.freedman_diaconis(lo, hi, F.lit(123), F.lit(0.0))).first()[0] == 1


def test_budget(spark):
    got = spark.range(1).select(N.min_samples(0.05, 0.05), N.outcome_budget(F.lit(14743), 0.05), N.min_samples(0.25, 0.25),
                                N.outcome_budget(F.lit(150), 0.25), N.min_samples(0.1, 0.1), N.outcome_budget(F.lit(1473), 0.1)).first()
    assert list(got) == pytest.approx([2951.1036, 36, 66.5421, 9, 599.1465, 14], abs=1e-4)
    counts = spark.createDataFrame([(0, 2952), (1, 2951), (2, 9000)], "idx int, n bigint")
    assert [r["idx"] for r in FT.cut_positions(counts, 0.05, 0.05, strict=False).collect()] == [0]
    with pytest.raises(Exception, match="not enough samples"):
        FT.cut_positions(counts, 0.05, 0.05).collect()
    with pytest.raises(ValueError):
        FT.cut_positions(counts, 0.05, 0.05, max_packets=0)


def test_integer_roots(spark):
    rows = spark.range(1, 3000).select("id", N.integer_root(F.col("id"), F.lit(3)).alias("c"), N.isqrt(F.col("id")).alias("s")).collect()
    for r in rows:
        assert r["c"] ** 3 <= r["id"] < (r["c"] + 1) ** 3
        assert r["s"] == math.isqrt(r["id"])


def profiles(spark, flows, order):
    """Histogram and metadata of flows given as (profile, conn, letters) over an alphabet of 4."""
    rows = [(p, c, i, 0.0, 0, "abxyc".index(letter) + 1) for p, c, word in flows for i, letter in enumerate(word)]
    features = spark.createDataFrame(rows, "side string, conn_id string, idx int, t double, d int, s int")
    row = spark.range(1).select(Q.mask("timestamp").alias("t"), Q.mask("direction").alias("d"), Q.identity("size").alias("s")).first()
    grams = P.ngrams(features, Quantizer.everywhere(row), order, ("side",))
    hist = P.histogram(grams, F.col("side"))
    meta = P.metadata(hist, Quantizer.everywhere(row), order).withColumn("alphabet_size", F.lit(4).cast("long"))
    return hist, meta


ORDER0 = [("P", f"p{i}", w) for i, w in enumerate(["a", "a", "a", "b"])] + [("Q", f"q{i}", w) for i, w in enumerate(["a", "c"])]
PAIRS = [("P", f"p{i}", w) for i, w in enumerate(["ax", "ax", "ay", "bx"])] + [("Q", f"q{i}", w) for i, w in enumerate(["ax", "by"])]


def test_kl_order0(spark):
    terms = D.kl_terms(*profiles(spark, ORDER0, 0), "P", "Q")
    assert sorted(r["contribution"] for r in terms.collect()) == pytest.approx([0.1013663, 0.6081977])
    assert D.total(D.delta(terms)).first()[0] == pytest.approx(0.7095639)


def test_kl_order1(spark):
    terms = D.kl_terms(*profiles(spark, PAIRS, 1), "P", "Q")
    deltas = D.delta(terms)
    assert [r[0] for r in values(deltas.select("delta", "idx"), "idx")] == pytest.approx([0.5362771, 0.7854787])
    assert [r[0] for r in values(D.cumulative(deltas).select("cumulative", "idx"), "idx")] == pytest.approx([0.5362771, 1.3217558])
    assert sorted(r["contribution"] for r in terms.where("idx = 1").collect()) == pytest.approx([0.1277064, 0.2554128, 0.4023595])
    assert D.max_position(deltas).first()["idx"] == 1


def test_kl_order2_chain_rule(spark):
    deltas = D.delta(D.kl_terms(*profiles(spark, PAIRS, 2), "P", "Q"))
    assert [r[0] for r in values(deltas.select("delta", "idx"), "idx")] == pytest.approx([0.5362771, 0.9678003])


def test_kl_without_pseudocount(spark):
    hist, meta = profiles(spark, PAIRS, 1)
    got = {(r["idx"], r["ctx"][0]["s"] if r["ctx"] else 0, r["sym"]["s"]): r["contribution"]
           for r in D.kl_terms(hist, meta.withColumn("alpha", F.lit(0.0)), "P", "Q").collect()}
    assert got[(1, 1, 4)] == math.inf  # context seen, symbol not
    same = hist.where("profile = 'P'")
    both = same.unionByName(same.withColumn("profile", F.lit("Q")))
    m = meta.where("profile = 'P'").withColumn("alpha", F.lit(0.0))
    zero = D.delta(D.kl_terms(both, m.unionByName(m.withColumn("profile", F.lit("Q"))), "P", "Q"))
    assert [r["delta"] for r in zero.collect()] == pytest.approx([0.0, 0.0])


def test_kl_refuses_different_profiles(spark):
    hist, meta = profiles(spark, PAIRS, 1)
    other = meta.withColumn("alphabet_size", F.when(F.col("profile") == "Q", F.lit(5).cast("long")).otherwise(F.col("alphabet_size")))
    with pytest.raises(Exception, match="not comparable"):
        D.kl_terms(hist, other, "P", "Q").collect()


def test_bounds(spark):
    v = F.lit(0.7095639)
    got = spark.range(1).select(D.pinsker(v), D.bretagnolle_huber(v), D.bayes_error_lower_bound(v), D.error_decay(v, 10)).first()
    assert list(got) == pytest.approx([0.5956358, 0.7128404, 0.2021821, 0.000828711], abs=1e-6)


def test_log_uniform(spark):
    lo, hi = Q.bounds("timestamp", F.lit(0.0), F.lit(15.0))
    row = spark.range(1).select(
        Q.make("loguniform", lo, hi, Q.log_width(lo, hi, F.lit(4))).alias("t"), Q.mask("direction").alias("d"), Q.mask("size").alias("s")).first()
    features = spark.createDataFrame([("c", i, t, 0, 1) for i, t in enumerate([0.0, 0.5, 1.5, 3.5, 7.5, 20.0])], "conn_id string, idx int, t double, d int, s int")
    got = QZ.symbols(features, Quantizer.everywhere(row)).orderBy("idx").collect()
    assert [r["sym"]["t"] for r in got] == [0, 0, 1, 2, 3, 3]
    assert {(r["sym"]["d"], r["sym"]["s"]) for r in got} == {(-1, -1)}


def test_domain(spark):
    rows = spark.createDataFrame([("c", 0, 0.0, 0, 1461), ("c", 1, float("nan"), 0, 5), ("c", 2, float("inf"), 1, 5), ("c", 3, -1.0, 2, 0)],
                                 "conn_id string, idx int, t double, d int, s int")
    with pytest.raises(Exception, match="out of range"):
        QZ.domain_guard(rows).collect()
    assert [r["idx"] for r in QZ.domain_guard(rows, "drop").collect()] == [2]
    assert {r["feature"]: r["outside"] for r in QZ.domain_violations(rows).collect()} == {"timestamp": 2, "direction": 1, "size": 2}
    assert QZ.domain_guard(QZ.domain_guard(rows, "clamp"), "drop").count() == 4
    with pytest.raises(Exception, match="outside the size domain"):
        spark.range(1).select(Q.bounds("size", F.lit(0.0))[0]).collect()
    with pytest.raises(ValueError):
        Q.identity("timestamp")


def test_uniform_from_md5(spark):
    row = spark.range(1).select(N.uniform("a"), N.uniform(7, 3, F.lit(12))).first()
    assert list(row) == [224400693268251 / 2**52, 1977886506867633 / 2**52]


def test_unusable_round_trips(spark, one_flow):
    flows, packets = one_flow
    flat = flows.withColumn("synack_ts", F.col("syn_ts")).withColumn("ack_ts", F.col("syn_ts"))
    # the flow stays, its time is unknown
    assert FL.preprocess(flat, packets).where("t is null").count() == packets.count()
    assert FL.unusable_rtt_count(FL.with_rtt(flat)).first()[0] == 1


def test_variance_of_one_value(spark):
    one = spark.createDataFrame([("c", 0, 1.5, 1, 7)], "conn_id string, idx int, t double, d int, s int")
    rows = S.moments(one).withColumn("v", S.variance()).collect()
    assert {r["feature"]: (r["mean"], r["m2"], r["v"]) for r in rows} == {"timestamp": (1.5, 0, 0), "direction": (1, 0, 0), "size": (7, 0, 0)}
