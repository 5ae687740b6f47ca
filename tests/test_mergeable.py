"""Results that come in parts: ledgers, sketches, observed counts, buckets, repeated flow rows of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from seqdrift.operators import assemble as A
from seqdrift.operators import flows as FL
from seqdrift.operators import profile as P
from seqdrift.schema import SYMBOL
from seqdrift.session import settled, shared_dir
from seqdrift.sources import artifacts as AR
from seqdrift.sources.ledger import Ledger
from seqdrift.streaming import counting as C
from tests.test_assemble import connection, frame

HIST = f"profile string, idx int, ctx array<{SYMBOL}>, sym {SYMBOL}, cnt long"


def hist(spark, seed, n=200, name="p"):
    rng = random.Random(seed)
    seen = {(rng.randrange(3), rng.randrange(9)): rng.randrange(1, 50) for _ in range(n)}
    return spark.createDataFrame([(name, i, [], (-1, 0, s), c) for (i, s), c in seen.items()], HIST)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_ledger_counts_each_shard_once(spark):
    ledger = Ledger(spark, shared_dir(spark, "ledger"), P.merge)
    with pytest.raises(ValueError, match="empty"):
        ledger.total()
    parts = [hist(spark, k) for k in range(4)]
    assert ledger.add("a", parts[0]) and not ledger.add("a", parts[1])
    # a hand-in that fails before its log row leaves no trace in the sum
    parts[3].write.parquet(f"{ledger.root}/data/lost")
    assert ledger.add("b", parts[1])
    assert rows(ledger.total()) == rows(P.merge(*parts[:2]))
    ledger.compact()
    assert not ledger.add("b", parts[3]) and ledger.add("c", parts[2])
    assert rows(ledger.total()) == rows(P.merge(*parts[:3])) and ledger.shards() == ["a", "b", "c"]
    ledger.compact(), ledger.compact()
    assert rows(ledger.total()) == rows(P.merge(*parts[:3]))


def test_two_jobs_with_one_shard(spark):
    ledger = Ledger(spark, shared_dir(spark, "ledger"), P.merge)
    part = hist(spark, 1)
    for k in range(2):  # both saw an empty log before they wrote
        part.write.parquet(f"{ledger.root}/data/{k}")
        ledger._commit("a", f"{ledger.root}/data/{k}", None)
    assert rows(ledger.total()) == rows(part.select("profile", "idx", "ctx", "sym", "cnt"))
    ledger._commit(None, f"{ledger.root}/data/0", ["a"])
    assert rows(ledger.total()) == rows(part.select("profile", "idx", "ctx", "sym", "cnt"))


def big(spark, name, low, n):
    sym = F.struct(F.lit(-1).alias("t"), (F.col("id") % 2).cast("int").alias("d"), F.col("id").cast("int").alias("s"))
    return spark.range(low, low + n).select(F.lit(name).alias("profile"), F.lit(0).alias("idx"), F.array().cast(f"array<{SYMBOL}>").alias("ctx"), sym.alias("sym"),
                                            F.lit(2).cast("long").alias("cnt"))


def test_support_of_merged_shards_and_overlap(spark):
    a, b = big(spark, "a", 0, 300_000), big(spark, "b", 200_000, 300_000)
    sketches = settled(P.support_sketches(a.unionByName(b)), "support")
    (whole,) = P.support_estimates(P.merge_support(sketches, into="all")).collect()
    assert whole.support_size == pytest.approx(500_000, rel=0.02) and whole.total == 1_200_000
    (both,) = P.support_overlap(sketches, "a", "b").collect()
    assert both.n_left == pytest.approx(300_000, rel=0.02) and both.n_both == pytest.approx(100_000, rel=0.06)


def test_heavy_contexts_are_all_found(spark):
    """A hundred heavy sequences among many light ones, in bounded sketches; merged parts equal the guarantee of one pass."""
    sym = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("d"), F.when(F.col("id") % 2 == 0, F.col("id") % 100).otherwise(F.col("id")).cast("int").alias("s"))
    grams = spark.range(200_000).select(F.col("id").alias("n"), F.lit(0).alias("idx"), F.array().cast(f"array<{SYMBOL}>").alias("ctx"), sym.alias("sym"))
    tracked, share = 1000, 0.005
    parts = [settled(P.frequent_contexts(grams.where(F.col("n") % 3 == k), tracked=tracked), "frequent") for k in range(3)]
    for sketch in (P.frequent_contexts(grams, tracked=tracked), P.merge_frequent(*parts, tracked=tracked)):
        found = P.heavy_contexts(sketch, share, tracked).collect()
        counts = {r.sym.s: r.cnt for r in found}
        assert {s for s in range(0, 100, 2)} <= set(counts) and all(r.total == 200_000 for r in found)
        assert all(2000 <= counts[s] <= 2000 + 200_000 // tracked for s in range(0, 100, 2))
    with pytest.raises(ValueError, match="finds shares"):
        P.heavy_contexts(sketch, 0.0001, tracked)


def test_reasons_are_counted_while_flows_are_written(spark):
    rng = random.Random(3)
    events = frame(spark, [r for k in range(80) for r in connection(rng, f"c{k}")])
    done = A.assemble(events)
    flows, seen = done.counted_flows()
    assert flows._jdf.queryExecution().optimizedPlan().toString().count("CollectMetrics") == 1
    path = shared_dir(spark, "flows")
    flows.write.parquet(path)
    assert {k: n for k, n in seen.get.items() if n} == {r.reason: r.n for r in done.reasons().collect()}
    assert rows(spark.read.parquet(path)) == rows(done.flows)


def test_bucketed_tables_need_no_exchange_by_flow(spark):
    path = shared_dir(spark, "buckets")
    flows = spark.range(300).select(F.concat(F.lit("c"), "id").alias("conn_id"), F.lit(1.0).alias("syn_ts"), F.lit(1.5).alias("synack_ts"),
                                    F.lit(2.0).alias("ack_ts"), F.lit(1).alias("ssl_est"), F.lit(8).cast("long").alias("len"))
    packets = spark.range(2400).select(F.concat(F.lit("c"), F.col("id") % 300).alias("conn_id"), F.floor(F.col("id") / 300).cast("int").alias("idx"),
                                       (F.col("id") * 0.25).alias("ts"), (F.col("id") % 2).cast("int").alias("direction"), F.lit(5).alias("size"))
    AR.save_bucketed(flows, packets, path, 4)
    kept = AR.load_bucketed(spark, path, 4, "kept" + path.rsplit("-", 1)[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        features = FL.preprocess(*kept, strip=True)
        raw = P.preceding(features, "conn_id", ["t", "d", "s"], 1, P.CHUNK)
        plan = raw._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 0 and "SortMergeJoin" in plan and "Window" in plan
        assert rows(features) == rows(FL.preprocess(flows, packets, strip=True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_last_flow_row_of_a_stream_wins(spark):
    path, out = shared_dir(spark, "rows"), shared_dir(spark, "latest")
    schema = "conn_id string, len long, order long, time timestamp"
    make = lambda rows: spark.createDataFrame(rows, "conn_id string, len long, order long, s double").select(
        "conn_id", "len", "order", F.timestamp_seconds("s").alias("time"))
    batches = [[("a", 1, 1, 100.0), ("b", 7, 9, 101.0)], [("a", 2, 3, 103.0), ("b", 8, 2, 102.0), ("c", 5, 1, 104.0)], [("a", 3, 2, 101.0)],
               [(None, 0, 0, 1e5)], [("a", 9, 1, 2e5)], [(None, 0, 0, 3e5)], [(None, 0, 0, 4e5)]]
    for rows_ in batches:
        make(rows_).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    C.stream_latest_flows(stream, "order", "time", 60.0, out, f"{out}-checkpoint", available_now=True).awaitTermination()
    assert rows(spark.read.parquet(out)) == [("a", 2), ("a", 9), ("b", 7), ("c", 5)]
