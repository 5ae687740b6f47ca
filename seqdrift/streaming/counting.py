"""Profiles and statistics over streams.

Counts, moments and sketches add up. What fits the result's size is held by Spark's own streaming aggregation
(`stream_profile`, `stream_moments`). Sketches and histograms of higher order are saved as partial results, one folder per
micro-batch named by its number: a batch that runs again after a failure replaces its own part, and readers add the parts.
An order-k profile needs the packets before each packet, whichever micro-batch brought them. Where the quantizer bounds the
positions of a flow, Spark's own aggregation collects them; flows without a bound, or with a time to live, have keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from seqdrift.operators import profile as P
from seqdrift.operators import stats as S
from seqdrift.operators.quantize import Quantizer, domain_guard
from seqdrift.streaming.assembler import STORE, keyed

FEATURE_ROWS = T.StructType([
    T.StructField("conn_id", T.StringType()), T.StructField("side", T.StringType()), T.StructField("idx", T.IntegerType()),
    T.StructField("t", T.DoubleType()), T.StructField("d", T.IntegerType()), T.StructField("s", T.IntegerType()),
])


def _whole(counts: DataFrame, out: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Writes the whole result of each micro-batch as one table. Its size is that of the profile, not of the data."""
    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    writer = counts.writeStream.outputMode("complete").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_profile(features: DataFrame, quantizer: Quantizer, population: str, out: str, checkpoint: str,
                   available_now: bool = False) -> StreamingQuery:
    """Order-0 histogram of a stream of feature rows, one profile per value of `population`.

    Table `out/<n>` holds the counts after micro-batch n. The quantizer is a static table.
    """
    grams = P.ngrams(features, quantizer, 0, (population,))
    return _whole(P.histogram(grams, F.col(population)), out, checkpoint, available_now)


def stream_moments(features: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Running moments per (feature, position)."""
    from seqdrift.operators.stats import moments

    return _whole(moments(features), out, checkpoint, available_now)


PACKETS = "array<struct<idx:int,t:double,d:int,s:int>>"


class History(StatefulProcessor):
    """Gives each packet the `order` packets before it. State of a flow: the number handed on, the last `order` packets,
    and packets that came before their turn. A packet that comes twice is handed on once."""

    def __init__(self, order: int, ttl_ms: int | None) -> None:
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "upto int, idx array<int>, t array<double>, d array<int>, s array<int>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        upto, *columns = self.held.get() or (0, [], [], [], [])
        known = {p[0]: p for p in zip(*columns)}
        known.update((r["idx"], (r["idx"], r["t"], r["d"], r["s"])) for r in rows if r["idx"] >= upto)
        while upto in known:
            past = [known[j] for j in range(upto - 1, max(-1, upto - 1 - self.order), -1)]
            own = known[upto]
            yield Row(conn_id=key[0], population=key[1], idx=own[0], t=own[1], d=own[2], s=own[3],
                      past=[Row(idx=p[0], t=p[1], d=p[2], s=p[3]) for p in past])
            upto += 1
        left = [p for i, p in sorted(known.items()) if i >= upto - self.order]
        self.held.update((upto, *([p[c] for p in left] for c in range(4))))

    def close(self) -> None:
        pass


def with_past(features: DataFrame, population: str, order: int, ttl: float | None = None) -> DataFrame:
    """A stream of feature rows with the `order` packets before each one (`past`, the nearest first), in any split and order of
    rows over micro-batches. Positions of a flow have no gaps; `ttl` is how many seconds of silence end the state of a flow."""
    keyed(features.sparkSession)
    rows = features.select("conn_id", F.col(population).cast("string").alias("population"), "idx", "t", "d", "s")
    processor = History(order, None if ttl is None else int(ttl * 1000))
    schema = f"conn_id string, population string, idx int, t double, d int, s int, past {PACKETS}"
    return rows.groupBy("conn_id", "population").transformWithState(processor, schema, "append", "None" if ttl is None else "ProcessingTime")


def with_listed_past(features: DataFrame, population: str, order: int) -> DataFrame:
    """The rows of `with_past` without Python: each flow is a list that Spark's own streaming aggregation keeps, for output mode update.

    State of a flow is all its packets, repeats too, so the caller bounds the positions. A packet is handed on in the micro-batch that
    completes the packets up to it; the time of a micro-batch, the same when it runs again, tells its packets from earlier ones."""
    features.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = features.where("idx >= 0").select("conn_id", F.col(population).cast("string").alias("population"), "idx",
                                             F.unix_micros(F.current_timestamp()).alias("at"), "t", "d", "s")
    flows = rows.groupBy("conn_id", "population").agg(
        F.sort_array(F.collect_list(F.struct("idx", "at", "t", "d", "s"))).alias("_all"), F.max("at").alias("_now"))
    flows = flows.withColumn("_once", F.filter("_all", lambda x, i: (i == 0) | (x["idx"] != F.get("_all", i - 1)["idx"]))).drop("_all")
    flows = flows.withColumn("_whole", F.filter("_once", lambda x, i: x["idx"] == i)).drop("_once")
    # handed on before: the packets in front of the first one of this micro-batch
    new = F.filter("_whole", lambda x: x["at"] == F.col("_now"))
    flows = flows.withColumn("_new", F.get(new, F.lit(0))["idx"]).where("_new is not null")

    def packets(x: Column, j: int) -> Column:
        return F.struct(*[F.get("_whole", x["idx"] - j)[c].alias(c) for c in ("idx", "t", "d", "s")])

    due = F.transform(F.slice("_whole", F.col("_new") + 1, F.size("_whole")), lambda x: F.struct(
        x["idx"].alias("idx"), x["t"].alias("t"), x["d"].alias("d"), x["s"].alias("s"),
        F.slice(F.array(*[packets(x, j) for j in range(1, order + 1)]), F.lit(1), F.least(F.lit(order), x["idx"])).alias("past")))
    return flows.select("conn_id", "population", F.explode(due).alias("_p")).select("conn_id", "population", "_p.*")


def stream_profile_order(features: DataFrame, quantizer: Quantizer, order: int, population: str, out: str, checkpoint: str,
                         guard: str = "fail", ttl: float | None = None, available_now: bool = False) -> StreamingQuery:
    """Order-k histogram of a stream. The history is raw and is quantized with the quantizer of the current position.

    Each micro-batch adds its counts below `out`; `streamed_profile` reads their sum. Packets behind the last position of the
    quantizer never reach the state."""
    if guard == "drop":
        raise ValueError("dropped packets leave gaps that the history would wait for; use fail or clamp")
    rows = domain_guard(features, guard)
    if quantizer.positions is not None:
        rows = rows.where(F.col("idx") < quantizer.positions)

    def count(batch: DataFrame, number: int) -> None:
        raw = batch.select("*", *[F.get("past", F.lit(j - 1)).alias(f"_lag{j}") for j in range(1, order + 1)])
        grams = P.with_history(raw, quantizer, order, ("population",))
        P.histogram(grams, F.col("population")).write.mode("overwrite").parquet(f"{out}/{number}")

    if quantizer.positions is None or ttl is not None:
        stream, mode = with_past(rows, population, order, ttl), "append"
    else:
        stream, mode = with_listed_past(rows, population, order), "update"
    writer = stream.writeStream.outputMode(mode).foreachBatch(count).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def streamed_profile(spark: SparkSession, out: str) -> DataFrame:
    """The histogram of all micro-batches so far."""
    return P.merge(spark.read.parquet(f"{out}/*"))


def stream_statistics(features: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Moments and quantile sketches per (feature, position): a partial summary per micro-batch, one row a position."""

    def summarise(batch: DataFrame, number: int) -> None:
        S.partial_summary(batch).write.mode("overwrite").parquet(f"{out}/{number}")

    writer = features.writeStream.foreachBatch(summarise).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def streamed_statistics(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Moments and merged sketches of all micro-batches so far."""
    return S.of_partials(spark.read.parquet(f"{out}/*"))


def stream_latest_flows(flow_rows: DataFrame, order: str, time: str, delay: float, out: str, checkpoint: str,
                        available_now: bool = False) -> StreamingQuery:
    """One row per conn_id of a stream of flow rows, the last one by `order`: `operators.flows.latest_flows` on a stream.

    Rows of an id count as repeats of each other while they are at most `delay` seconds of `time` (a timestamp) apart, and are
    written when the watermark, `delay` behind, has passed the last of them. State is one row per id within that time."""
    columns = [c for c in flow_rows.columns if c not in ("conn_id", order, time)]
    wait = f"{int(delay * 1000)} milliseconds"
    newest = flow_rows.withWatermark(time, wait).groupBy(F.session_window(time, wait), "conn_id").agg(
        F.max_by(F.struct(*columns), F.col(order)).alias("_f"), F.count("conn_id").alias("_n"))
    # rows without an id only move the watermark on; a filter on the id itself would be pushed below the watermark
    last = newest.where("_n > 0").select("conn_id", *[F.col("_f")[c].alias(c) for c in columns])
    writer = last.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
