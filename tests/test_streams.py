"""Streaming profiles and statistics: any split of rows, repeated rows, repeated micro-batches, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from seqdrift.functions import quantizing as Q
from seqdrift.operators import profile as P
from seqdrift.operators import stats as S
from seqdrift.operators.quantize import Quantizer
from seqdrift.session import shared_dir
from seqdrift.streaming import counting as C
from tests.test_assemble import Handle, State


class Columns(State):
    def get(self):
        return self.store.get(self.name)


class OneState(Handle):
    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        return Columns(self.state, name)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_history_over_any_split(order):
    rng = random.Random(order)
    for n in (1, 2, 9, 40):
        rows = [{"idx": i, "t": i * 0.5, "d": i % 2, "s": i + 1} for i in range(n)]
        want = [(i, [(j, j * 0.5, j % 2, j + 1) for j in range(i - 1, max(-1, i - 1 - order), -1)]) for i in range(n)]
        for _ in range(10):
            dealt = rows + rng.sample(rows, n // 3)  # some come twice
            rng.shuffle(dealt)
            state, found = OneState(), []
            processor = C.History(order, None)
            processor.init(state)
            while dealt:
                k = rng.randrange(1, 8)
                found += list(processor.handleInputRows(("c", "p"), iter(dealt[:k]), None))
                dealt = dealt[k:]
            assert [(r.idx, [tuple(p) for p in r.past]) for r in found] == want
            assert len(state.state["held"][1]) <= order


def test_a_gap_is_waited_for_and_state_stays_small_in_order():
    processor, state = C.History(2, None), OneState()
    processor.init(state)
    row = lambda i: {"idx": i, "t": 0.0, "d": 0, "s": 1}
    assert [r.idx for r in processor.handleInputRows(("c", None), iter([row(0), row(2), row(3)]), None)] == [0]
    assert [r.idx for r in processor.handleInputRows(("c", None), iter([row(1)]), None)] == [1, 2, 3]
    for i in range(4, 200):
        assert [r.idx for r in processor.handleInputRows(("c", None), iter([row(i)]), None)] == [i]
        assert len(state.state["held"][1]) == 2


def features(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", "pq"[c % 2], i, rng.random() * 9, rng.randrange(2), rng.randrange(1, 6)) for c in range(60) for i in range(rng.randrange(1, 9))]
    return rows, spark.createDataFrame(rows, C.FEATURE_ROWS)


def quantizer(spark):
    row = spark.range(1).select(Q.mask("timestamp").alias("t"), Q.identity("direction").alias("d"), Q.identity("size").alias("s")).first()
    return Quantizer.everywhere(row)


def test_profile_of_a_stream_equals_the_batch_after_a_restart(spark):
    rows, whole = features(spark)
    rng = random.Random(4)
    rng.shuffle(rows)
    path, out = shared_dir(spark, "rows"), shared_dir(spark, "counts")
    q = quantizer(spark)
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, C.FEATURE_ROWS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(C.FEATURE_ROWS).option("maxFilesPerTrigger", 1).parquet(path)
        C.stream_profile_order(stream, q, 2, "side", out, f"{out}-checkpoint", available_now=True).awaitTermination()
    want = P.as_text(P.histogram(P.ngrams(whole, q, 2, ("side",)), F.col("side")))
    got = P.as_text(C.streamed_profile(spark, out)).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="gaps"):
        C.stream_profile_order(stream, q, 1, "side", out, out, guard="drop")


@pytest.mark.parametrize("order", [1, 3])
def test_flows_of_bounded_length_need_no_python_state(spark, order):
    rows, whole = features(spark)
    rng = random.Random(order)
    dealt = rows + rng.sample(rows, 60)  # some come twice
    rng.shuffle(dealt)
    path, out = shared_dir(spark, "rows"), shared_dir(spark, "counts")
    kinds = [Q.mask("timestamp").alias("t"), Q.identity("direction").alias("d"), Q.identity("size").alias("s")]
    q = Quantizer.per_packet(spark.range(7).select(F.col("id").cast("int").alias("idx"), *kinds), 7)
    for part in (dealt[:90], dealt[90:100], dealt[100:]):
        spark.createDataFrame(part, C.FEATURE_ROWS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(C.FEATURE_ROWS).option("maxFilesPerTrigger", 1).parquet(path)
        run = C.stream_profile_order(stream, q, order, "side", out, f"{out}-checkpoint", available_now=True)
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["operatorName"] == "stateStoreSave"
    want = P.as_text(P.histogram(P.ngrams(whole, q, order, ("side",), length=7), F.col("side")))
    got = P.as_text(C.streamed_profile(spark, out)).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_statistics_of_a_stream_count_a_repeated_batch_once(spark):
    rows, whole = features(spark)
    out = shared_dir(spark, "summaries")
    for number, part in enumerate((rows[:100], rows[100:], rows[100:])):
        batch = spark.createDataFrame(part, C.FEATURE_ROWS)
        S.partial_summary(batch).write.mode("overwrite").parquet(f"{out}/{min(number, 1)}")  # the second runs again
    moments, sketches = C.streamed_statistics(spark, out)
    want = {(r.feature, r.idx): r for r in S.moments(whole).collect()}
    got = {(r.feature, r.idx): r for r in moments.collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k].cnt, got[k].min, got[k].max) == (r.cnt, r.min, r.max)
        assert got[k].mean == pytest.approx(r.mean) and got[k].m2 == pytest.approx(r.m2, abs=1e-9)
    exact = {(r.feature, r.idx): r for r in S.quantiles_of_sketches(S.quantile_sketches(whole)).collect()}
    assert {k: tuple(r) for k, r in exact.items()} == {(r.feature, r.idx): tuple(r) for r in S.quantiles_of_sketches(sketches).collect()}


