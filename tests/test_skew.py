"""The forms for very large keys give what the plain forms give."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqdrift.operators import assemble as A
from seqdrift.operators import profile as P
from seqdrift.operators import sampling as SA
from seqdrift.operators import skew as K
from seqdrift.operators import stats as S
from seqdrift.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for key, n in (("hot", 400), ("warm", 30), ("cold", 3)):
        for i in range(n):
            data.append((key, rng.randrange(60), len(data), rng.randrange(2), rng.randrange(1, 50)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, at int, id int, d int, v int").repartition(5).cache()


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cuts_split_the_hot_key(rows):
    cuts = K.measure_cuts(rows, "k", "at", 25)
    assert {r["k"] for r in cuts.table.collect()} == {"hot", "warm"}
    chunks = cuts.assign(rows).groupBy("k").agg(F.countDistinct("chunk").alias("n"), F.count("*").alias("rows")).collect()
    assert {r["k"]: r["rows"] for r in chunks} == {"hot": 400, "warm": 30, "cold": 3}
    assert {r["k"]: r["n"] for r in chunks}["cold"] == 1
    assert {r["k"]: r["n"] for r in chunks}["hot"] > 20
    assert K.measure_cuts(rows, "k", "at", 1000).table is None


def test_numbering_and_sums(rows):
    order = [F.col("at"), F.col("id")]
    none, cuts = K.Cuts("k", "at", None), K.measure_cuts(rows, "k", "at", 25)
    names = ("k", "id", "idx")
    assert collected(K.number_rows(rows, "k", order, none).select(*names)) == collected(K.number_rows(rows, "k", order, cuts).select(*names))
    sums = [K.exclusive_sums(rows, ["k", "d"], order, {"before": F.col("v")}, c).select("k", "id", "before") for c in (none, cuts)]
    assert collected(sums[0]) == collected(sums[1])


@pytest.mark.parametrize("chunk", [1, 3, 64, 1000])
def test_previous_by_direction(rows, chunk):
    numbered = K.number_rows(rows, "k", [F.col("at"), F.col("id")], K.Cuts("k", "at", None))
    # a long one-sided stretch: the other direction is carried over many chunks
    one_sided = numbered.withColumn("d", F.when(F.col("idx").between(20, 300), 1).otherwise(F.col("d")))
    forms = [K.previous_by_direction(one_sided, "k", "at", F.col("d") > 0.5, c).select("k", "idx", "prev") for c in (None, chunk)]
    expected = one_sided.withColumn("prev", F.lag("at").over(W.partitionBy("k", "d").orderBy("idx"))).select("k", "idx", "prev")
    assert collected(forms[0]) == collected(expected)
    assert collected(forms[1]) == collected(expected)


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_preceding(rows, chunk):
    numbered = K.number_rows(rows, "k", [F.col("at"), F.col("id")], K.Cuts("k", "at", None))
    got = K.preceding(numbered, "k", ["v"], 2, chunk).select("k", "idx", F.col("_lag1.v").alias("a"), F.col("_lag2.v").alias("b"))
    w = W.partitionBy("k").orderBy("idx")
    expected = numbered.select("k", "idx", F.lag("v", 1).over(w).alias("a"), F.lag("v", 2).over(w).alias("b"))
    assert collected(got) == collected(expected)


def test_exact_quantiles_beyond_one_task(spark):
    features = T.order_features(spark, SF)
    columns = ("feature", "idx", "q01", "q25", "q50", "q75", "q99")
    plain = {tuple(r[:2]): r[2:] for r in S.exact_quantiles(features).select(*columns).collect()}
    cut = {tuple(r[:2]): r[2:] for r in S.exact_quantiles(features, limit=0).select(*columns).collect()}
    assert plain.keys() == cut.keys() and len(plain) > 20
    for k, v in plain.items():
        assert list(cut[k]) == pytest.approx(list(v))


def test_tables_with_hot_keys(spark, small_chunks):
    def everything():
        flows, packets = T.event_flows(spark, SF)
        return [collected(flows), collected(packets), collected(T.packet_events(spark, SF).drop("payload_prefix")),
                collected(T.order_features(spark, SF)), collected(T.conversation_features(spark, SF))]

    plain = everything()
    with small_chunks:
        assert T.event_chunk(spark, SF) == 4
        cut = everything()
    assert plain == cut


def test_assembly_with_hot_connections(spark, small_chunks):
    events = T.packet_events(spark, SF).cache()
    plain = A.assemble(events)
    expected = [collected(plain.flows), collected(plain.packets), collected(plain.reasons())]
    with small_chunks:
        cut = A.assemble(events)
        assert [collected(cut.flows), collected(cut.packets), collected(cut.reasons())] == expected


@pytest.mark.parametrize("n", [0, 1, 57, 500, 10_000])
def test_smallest_rows(spark, n):
    ids = spark.range(500).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("conn_id"))
    got = collected(SA.smallest(ids, n, 3))
    expected = [tuple(r) for r in ids.orderBy(SA._u(3), "conn_id").limit(n).collect()]
    assert got == sorted(expected, key=repr)


def test_ngrams_do_not_depend_on_chunks(spark, monkeypatch):
    from seqdrift.functions import quantizing as Q
    from seqdrift.operators.quantize import Quantizer

    features = T.order_features(spark, SF)
    row = spark.range(1).select(Q.mask("timestamp").alias("t"), Q.identity("direction").alias("d"), Q.identity("size").alias("s")).first()
    whole = collected(P.ngrams(features, Quantizer.everywhere(row), 2))
    monkeypatch.setattr(P, "CHUNK", 2)
    assert collected(P.ngrams(features, Quantizer.everywhere(row), 2)) == whole


def test_readme_example(spark, small_chunks):
    from seqdrift.operators import fit
    from seqdrift.operators.flows import chunk_for, preprocess
    from seqdrift.plans import compare
    from seqdrift.session import settled

    flows, packets = T.event_flows(spark, SF)
    flows = settled(flows.withColumn("site", F.when(F.crc32("conn_id") % 2 == 0, "north").otherwise("south")), "flows")
    packets = settled(packets, "packets")
    assert chunk_for(flows) is None
    plain = collected(preprocess(flows, packets, strip=True, carry=("site",)))
    with small_chunks:
        assert chunk_for(flows) == 4
        features = settled(preprocess(flows, packets, strip=True, chunk=chunk_for(flows), carry=("site",)), "features")
    assert collected(features) == plain
    quantizer = fit.fitted(features, order=1, epsilon=0.5, delta=0.5, mask=("timestamp",), max_packets=5)
    profile = compare.build_profile(features, quantizer, 1, population="site")
    assert compare.position_divergence(profile, "north", "south").count() == 5
