"""Generated sequences, and invariants of profiles."""

from collections import Counter

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqdrift.functions import quantizing as Q
from seqdrift.operators import divergence as D
from seqdrift.operators import fit as FT
from seqdrift.operators import generate as G
from seqdrift.operators import profile as P
from seqdrift.operators import quantize as QZ
from seqdrift.operators.quantize import Quantizer
from seqdrift.plans import compare as C
from seqdrift.session import settled
from seqdrift.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    return settled(T.order_features(spark, SF), "features")


@pytest.fixture(scope="module")
def timed(features):
    q = FT.fitted(features, 1, epsilon=0.1, delta=0.1, strict=False)
    return q, C.build_profile(features, q, 1)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_generated_sequences(spark, features, timed):
    q, p = timed
    rows = G.generate(p.hist, q, 1, 400, 4, seed=3).cache()
    assert rows.count() == 1600
    assert rows.groupBy("conn_id").count().where("count != 4").count() == 0
    assert rows.where("conn_id = 'synthetic-flow-00000399'").count() == 4
    # symbols lie in the support of their position, values quantize back to their symbol
    known = p.hist.select("idx", "sym").distinct()
    assert rows.join(known, ["idx", "sym"], "left_anti").count() == 0
    back = QZ.symbols(rows.select("conn_id", "idx", "t", F.col("d").cast("int").alias("d"), F.col("s").cast("int").alias("s"), F.col("sym").alias("drawn")), q)
    assert back.where("sym.d != drawn.d or sym.s != drawn.s").count() == 0
    falling = rows.withColumn("before", F.lag("t").over(W.partitionBy("conn_id").orderBy("idx"))).where("t < before")
    assert falling.count() == 0
    assert {r["idx"]: r["drawn"] for r in G.fallbacks(rows, 1).collect()} == {0: 400, 1: 400, 2: 400, 3: 400}


def test_seed_fixes_everything(spark, timed):
    q, p = timed
    one = collected(G.generate(p.hist, q, 1, 60, 3, seed=3))
    assert one == collected(G.generate(p.hist.repartition(7), q, 1, 60, 3, seed=3))
    assert one != collected(G.generate(p.hist, q, 1, 60, 3, seed=4))
    # a longer run starts like a shorter one
    more = collected(G.generate(p.hist, q, 1, 80, 3, seed=3).where("conn_id < 'synthetic-flow-00000060'"))
    assert one == more


def test_shares_follow_the_counts(spark, features, timed):
    q, _ = timed
    hist = C.build_profile(features, q, 0).hist
    drawn = G.generate_order0(hist, 20_000, 1, seed=9)
    share = {r["sym"]: r["cnt"] / 1473 for r in hist.where("idx = 0").collect()}
    got = Counter(r["sym"] for r in drawn.collect())
    assert sum(got.values()) == 20_000
    for sym, p in share.items():
        assert got[sym] / 20_000 == pytest.approx(p, abs=0.015)


def test_one_lookup_draws_the_same_rows(spark, features, monkeypatch):
    q = FT.fitted(features, 3, epsilon=0.1, delta=0.1, mask=("timestamp",), strict=False)
    hist = C.build_profile(features, q, 3).hist
    monkeypatch.setattr(G, "ONE_LOOKUP", 99)
    want = collected(G.generate(hist, q, 3, 150, 4, seed=5))
    for least in (0, 2):
        monkeypatch.setattr(G, "ONE_LOOKUP", least)
        assert collected(G.generate(hist, q, 3, 150, 4, seed=5)) == want
    assert {r[-1] for r in want} >= {0, 1, 2}


def test_joins_of_a_position_do_not_grow_with_the_order(spark):
    """A position of orders 2, 4 and 8 costs the same joins: one with the tree, one with the answer."""
    symbol = "struct<t:int,d:int,s:int>"
    joins = []
    for depth in (2, 4, 8):
        nodes = spark.createDataFrame([], f"level int, ctx array<{symbol}>, slice int, lo long, hi long, total long, sym {symbol}")
        here = spark.range(5).select(F.col("id").alias("n"), F.lit(0.5).alias("_u"), F.lit(32).alias("_slice"))
        past = [F.struct(F.lit(-1).alias("t"), F.lit(j).alias("d"), F.col("n").cast("int").alias("s")) for j in range(depth)]
        plan = G._by_one_lookup(here, nodes, past)._jdf.queryExecution().analyzed().toString()
        joins.append(plan.count("Join "))
    assert joins == [2, 2, 2]


def test_state_is_written_between_positions(spark, timed, monkeypatch):
    q, p = timed
    whole = collected(G.generate(p.hist, q, 1, 50, 4, seed=1))
    monkeypatch.setattr(G, "WRITE_EVERY", 2)
    assert collected(G.generate(p.hist, q, 1, 50, 4, seed=1)) == whole


def test_unseen_contexts_fall_back(spark):
    quantizer = Quantizer.everywhere(spark.range(1).select(Q.mask("timestamp").alias("t"), Q.mask("direction").alias("d"), Q.identity("size").alias("s")).first())
    sym = "struct<t:int,d:int,s:int>"
    # position 1 knows only the context 9, which position 0 never draws
    hist = spark.createDataFrame([(0, [], (-1, -1, 5), 3), (1, [(-1, -1, 9)], (-1, -1, 7), 2)], f"idx int, ctx array<{sym}>, sym {sym}, cnt bigint")
    rows = G.generate(hist, quantizer, 1, 10, 2, seed=1)
    assert {(r["idx"], r["s"]) for r in rows.collect()} == {(0, 5.0), (1, 7.0)}
    assert {r["idx"]: r["fallbacks"] for r in G.fallbacks(rows, 1).collect()} == {0: 0, 1: 10}


def test_length_is_checked(timed):
    _, p = timed
    with pytest.raises(ValueError, match="exceeds"):
        G.check_length(p.meta, 50)


def test_profiles_add_up(spark, features, timed):
    q, p = timed
    sides = C.build_profile(features, q, 1, "side")
    merged = C.merge_profiles(sides, into="all")
    columns = ("idx", "ctx", "sym", "cnt")
    assert collected(merged.hist.select(*columns)) == collected(p.hist.select(*columns))
    assert collected(merged.meta.select("idx", "total")) == collected(p.meta.select("idx", "total"))
    longer = features.groupBy("idx").count()
    assert p.meta.join(longer, "idx").where("total != count").count() == 0
    mixed = sides.meta.withColumn("alpha", F.when(F.col("profile") == "P", F.lit(2.0)).otherwise(F.col("alpha")))
    with pytest.raises(Exception, match="differ in kind"):
        P.merge_metadata(mixed, into="all").collect()
    with pytest.raises(ValueError):
        C.merge_profiles(sides, C.Profile(sides.hist, sides.meta, 2))


def test_total_is_the_sum_of_deltas(spark, features, timed):
    q, _ = timed
    deltas = C.position_divergence(C.build_profile(features, q, 1, "side"), "P", "Q")
    listed = [r["delta"] for r in deltas.orderBy("idx").collect()]
    assert D.total(deltas).first()[0] == pytest.approx(sum(listed))
    assert len(listed) == q.positions


def test_stripping_first_or_later(spark):
    from seqdrift.operators import flows as FL

    flows, packets = T.event_flows(spark, SF)
    stripped = FL.strip_handshake(packets.join(flows.select("conn_id", "ssl_est"), "conn_id")).drop("ssl_est")
    columns = ("conn_id", "idx", "t", "d", "s")
    assert collected(FL.preprocess(flows, packets, strip=True).select(*columns)) == collected(FL.preprocess(flows, stripped).select(*columns))


def test_display(timed):
    q, p = timed
    rows = P.display(p.hist, "all", 0, top_k=3, quantizer=q).collect()
    assert len(rows) == 3 and rows[0]["cnt"] >= rows[1]["cnt"] >= rows[2]["cnt"]
    assert "[0.0000, 0.0000)" in rows[0]["sequence"]
    with pytest.raises(ValueError):
        P.display(p.hist, "all", 0, top_k=0)


def test_tables_of_a_quantizer_are_not_dealt_out_with_draws(spark, features):
    """Joins with the model move packets and symbols; the bins of a position, as large as thousands of packets, stay behind."""
    q = FT.fitted(features, 2, epsilon=0.1, delta=0.1, mask=("timestamp",), strict=False)
    assert "empirical" in q.kinds["s"]
    model = C.build_profile(features, q, 2).hist
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = G.generate(model, q, 2, 50, 3, seed=1)._jdf.queryExecution()
        moved = [n.output().mkString(" ") for n in nodes(plan.sparkPlan()) if n.nodeName() == "SortMergeJoin"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and not any("_qs#" in out for out in moved)


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))
