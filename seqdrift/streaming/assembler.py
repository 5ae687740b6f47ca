"""Flow assembly from a stream of packet events, with keyed state.

Each connection has a record (`Connection`), the packets taken in so far, at most the horizon, and events that wait for
their turn. Events may come shuffled, late and repeated: they wait until the watermark has passed their time and are then
applied by arrival, so `delay` must cover how far the tap's order and the timestamps differ. A connection is written at
its 50th packet, at its `end` event, or after `idle` seconds of silence, whichever comes first. From then on a done
flag swallows what still comes for it, and expires `keep` seconds after the last of it. So the state of a connection is a record,
50 packets and the events of its last `delay` seconds, and it is gone some time after the connection.

State lives in the state store of the stream, results in a file sink: after a failure the query goes on from its
checkpoint and writes nothing twice. Unlike the batch form, which sees the end of the table first, a SYN after
the 50th packet does not undo a flow that has been written.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from seqdrift.schema import FLOW_LOG, HORIZON, PACKET_EVENTS
from seqdrift.session import shipped
from seqdrift.streaming.connection import END, Connection

__all__ = ["END", "assembled", "packet_stream", "reasons", "stream_assemble", "tick"]

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "arrival long, ms long, ts double, is_orig boolean, flags string, seq long, len long, head string, event string, version string"
EVENT_FIELDS = [f.split(" ")[0] for f in EVENT.split(", ")]
PACKET = "ts double, direction int, size int"
RECORD = Connection.schema() + ", last_ms long, waiting long, timer long"
FLOW_FIELDS = FLOW_LOG.fieldNames()[1:]
OUTCOME = (
    "conn_id string, flow struct<syn_ts:double,synack_ts:double,ack_ts:double,version:string,client_hello:int,server_hello:int,ssl_est:int,len:bigint>,"
    " packets array<struct<ts:double,direction:int,size:int>>, reasons array<string>"
)


def keyed(spark: SparkSession) -> None:
    """What keyed state needs of a session: a store on disk, and this package in the executors' Python."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    shipped(spark)


def packet_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Packet events from a growing folder of Parquet files, oldest first."""
    reader = spark.readStream.schema(PACKET_EVENTS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def tick(spark: SparkSession, ts: float) -> DataFrame:
    """An event of no connection that moves the watermark on, so that a tap that falls silent still ends its connections."""
    values = {"conn_id": None, "arrival": 0, "ts": ts}
    return spark.createDataFrame([tuple(values.get(c) for c in PACKET_EVENTS.fieldNames())], PACKET_EVENTS)


class Assembler(StatefulProcessor):
    """State per connection: record (value), packets taken in and waiting events (lists), one event-time timer."""

    def __init__(self, allow_shorter: bool, horizon: int, idle_ms: int, keep_ms: int) -> None:
        self.allow_shorter, self.horizon, self.idle_ms, self.keep_ms = allow_shorter, horizon, idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)
        self.packets = handle.getListState("packets", PACKET)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        if key[0] is None:
            return
        yield from self._go_on(key[0], [tuple(r[c] for c in EVENT_FIELDS) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._go_on(key[0], [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _go_on(self, conn_id: str, new: list[tuple], now: int, fired: int | None = None) -> Iterator[Row]:
        known = self.record.get()
        if known is None:
            connection, last_ms, held, timer = Connection(), -1, 0, None
        else:
            *values, last_ms, held, timer = known
            connection = Connection(*values)
        if timer is not None and timer == fired:
            timer = None
        if connection.over:
            self._swallow(known, max([last_ms, *(e[1] for e in new)]), now, timer)
            return
        events = {e[0]: e for e in self.waiting.get()} if held else {}
        events.update((e[0], e) for e in new if connection.last_arrival is None or e[0] > connection.last_arrival)
        last_ms = max([last_ms, *(e[1] for e in new)])
        order, done = sorted(events), 0
        void, taken = False, []
        while done < len(order) and not connection.over and events[order[done]][1] <= now:
            reset, packet = connection.apply(dict(zip(EVENT_FIELDS, events[order[done]])), self.horizon)
            if reset:
                void, taken = True, []
            if packet is not None:
                taken.append(packet)
            done += 1
        left = order[done:]
        # silence counts from the last event, once everything before it has had its turn
        silent = not left and not connection.over and now >= last_ms + self.idle_ms
        if connection.over or silent:
            yield from self._finish(conn_id, connection, void, taken)
            self.packets.clear()
            if held:
                self.waiting.clear()
            connection, left = Connection(over=True), []
            last_ms, due = max(last_ms, now), max(last_ms, now) + self.keep_ms
        else:
            if void:
                self.packets.put(taken) if taken else self.packets.clear()
            elif taken:
                self.packets.appendList(taken)
            if left and (new or done):
                self.waiting.put([events[a] for a in left])
            elif held and not left:
                self.waiting.clear()
            due = events[left[0]][1] + 1 if left else last_ms + self.idle_ms
        due = max(due, now + 1)
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.record.update((*connection.values(), last_ms, len(left), due))

    def _swallow(self, known: tuple, newest: int, now: int, timer: int | None) -> None:
        """The done flag: later events prolong it, written down only when half its time has passed."""
        last_ms = known[-3]
        if timer is None and now >= newest + self.keep_ms:
            self.record.clear()
        elif timer is None or newest > last_ms + self.keep_ms // 2:
            due = max(newest + self.keep_ms, now + 1)
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            self.record.update((*known[:-3], newest, 0, due))

    def _finish(self, conn_id: str, connection: Connection, void: bool, taken: list[tuple]) -> Iterator[Row]:
        why = connection.reasons(self.allow_shorter, self.horizon)
        if not why:
            return
        flow = connection.flow(self.allow_shorter, self.horizon)
        packets = ([] if void else [tuple(p) for p in self.packets.get()]) + taken if flow else []
        yield Row(conn_id=conn_id, flow=None if flow is None else Row(**flow), packets=[Row(ts=t, direction=d, size=s) for t, d, s in packets], reasons=why)

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, allow_shorter: bool = True, idle: float = 3600.0, delay: float = 60.0, keep: float | None = None,
             horizon: int = HORIZON) -> DataFrame:
    """The stream of ended connections: conn_id, flow (null if it was discarded), packets, reasons."""
    keyed(events.sparkSession)
    rows = events.select(
        "conn_id", "arrival", F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("_time"), (F.col("ts") * 1000).cast("long").alias("ms"),
        "ts", "is_orig", "flags", "seq", "len", F.substring(F.hex("payload_prefix"), 1, 6).alias("head"), "event", "version",
    ).withWatermark("_time", f"{int(delay * 1000)} milliseconds")
    keep = delay if keep is None else keep
    processor = Assembler(allow_shorter, horizon, int(idle * 1000), int(keep * 1000))
    return rows.groupBy("conn_id").transformWithState(processor, OUTCOME, "append", "EventTime")


def stream_assemble(events: DataFrame, out: str, checkpoint: str, allow_shorter: bool = True, idle: float = 3600.0, delay: float = 60.0,
                    keep: float | None = None, available_now: bool = False) -> StreamingQuery:
    """Starts assembling. Ended connections are appended to the table `out`, each one once."""
    ended = outcomes(events, allow_shorter, idle, delay, keep)
    writer = ended.writeStream.format("parquet").option("path", f"{out}/ended").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _ended(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(OUTCOME).parquet(f"{out}/ended")


def assembled(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Flows and packets written so far."""
    ended = _ended(spark, out).where("flow is not null")
    packets = ended.select("conn_id", F.posexplode("packets").alias("idx", "_p")).select("conn_id", "idx", "_p.*")
    return ended.select("conn_id", *[F.col(f"flow.{c}").alias(c) for c in FLOW_FIELDS]), packets


def reasons(spark: SparkSession, out: str) -> DataFrame:
    return _ended(spark, out).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
