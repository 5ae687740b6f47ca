"""Clean flows from raw packet events, by window functions.

A flow is watched from its handshake on. The first packet that breaks a rule ends it, and so does the
50th packet. What was taken in before that, the clean prefix, is still written when short flows are
allowed and the prefix itself passes the final check.

Order is `arrival`, the order in which the tap saw the events, never the timestamp.

A connection has one establishment and one first-ACK event; the earliest row of each counts. Of repeated
SYNs the last one opens the record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqdrift.operators.skew import chunk_rows, hot_keys
from seqdrift.schema import HORIZON
from seqdrift.session import settled

# Discard reasons.
SYNACK_BEFORE_SYN = "saw SYN+ACK before SYN"
MISSED_SYNACK = "missed SYN+ACK"
ACK_BEFORE_SYNACK = "saw ACK before SYN+ACK"
INCOMPLETE = "incomplete TCP handshake"
BAD_SEQUENCE = "unexpected sequence number"
NO_CLIENT_HELLO = "missed TLS Client Hello"
NO_SERVER_HELLO = "missed TLS Server Hello"
OUT_OF_ORDER = "saw data packets out-of-order"
TOO_SHORT = "flow too short"
SUCCESS = "success"
REASONS = (SYNACK_BEFORE_SYN, MISSED_SYNACK, ACK_BEFORE_SYNACK, INCOMPLETE, BAD_SEQUENCE, NO_CLIENT_HELLO, NO_SERVER_HELLO, OUT_OF_ORDER, TOO_SHORT, SUCCESS)
# First payload bytes, as hex, of handshake and application-data records.
HANDSHAKE_RECORD = "^16030[0-3]"
APPLICATION_RECORD = "^17030[0-3]"
MILESTONES = ("client_hello", "server_hello", "ssl_est")


def _flag(name: str) -> Column:
    return F.coalesce(F.col("flags"), F.lit("")) == name


def handshakes(events: DataFrame) -> DataFrame:
    """One row per connection with a SYN: three times, the arrival at which all are set, discard reasons.

    Plain grouped minima and maxima, so partial results are formed before the shuffle.
    """
    at = F.col("arrival")
    first_ack = F.col("is_orig") & F.coalesce(F.col("flags"), F.lit("")).contains("A")
    mark = F.struct("arrival", "ts")
    seen = events.where(F.coalesce(F.col("flags"), F.lit("")) != "").groupBy("conn_id").agg(
        F.max(F.when(_flag("S") & F.col("is_orig"), mark)).alias("syn"),
        F.min(F.when(_flag("SA") & ~F.col("is_orig"), mark)).alias("sa"),
        F.min(F.when(first_ack, mark)).alias("ack"),
    ).where(F.col("syn").isNotNull())
    syn_at = F.col("syn.arrival")
    sa = F.when(F.col("sa.arrival") > syn_at, F.col("sa"))
    ack = F.when(F.col("ack.arrival") > syn_at, F.col("ack"))
    out = seen.select("conn_id", syn_at.alias("syn_at"), F.col("syn.ts").alias("syn_ts"), sa.alias("sa"), ack.alias("ack"))
    known_at_ack = F.coalesce(F.col("sa.arrival") < F.col("ack.arrival"), F.lit(False))
    out = out.select(
        "conn_id", "syn_at", "syn_ts", F.col("sa.ts").alias("synack_ts"), F.col("ack.ts").alias("ack_ts"),
        F.col("sa.arrival").alias("synack_at"), F.col("ack.arrival").alias("ack_at"),
        F.when(F.col("syn_ts") > F.col("sa.ts"), F.lit(SYNACK_BEFORE_SYN)).alias("synack_fault"),
        F.when(F.col("ack").isNotNull() & ~known_at_ack, F.lit(MISSED_SYNACK))
        .when(F.col("sa.ts") > F.col("ack.ts"), F.lit(ACK_BEFORE_SYNACK)).alias("ack_fault"),
    )
    complete = F.col("synack_ts").isNotNull() & F.col("ack_ts").isNotNull()
    return out.withColumn("complete_at", F.when(complete, F.greatest("synack_at", "ack_at")))


def _milestone_rows(events: DataFrame, shakes: DataFrame) -> DataFrame:
    """Milestone events (a few per connection) beside the handshake of their connection."""
    rows = events.where(F.col("event").isin(*MILESTONES)).select("conn_id", "arrival", "event", "version")
    return rows.join(shakes.select("conn_id", "syn_at", "complete_at"), "conn_id").where(
        F.col("arrival") > F.col("syn_at")
    )


def checked_handshakes(events: DataFrame) -> DataFrame:
    """Handshakes with the milestones that decide about later packets.

    A milestone before the handshake is complete discards the flow. `watched` flows are those whose
    packets are looked at.
    """
    shakes = handshakes(events)
    at = F.col("arrival")
    after = F.coalesce(at >= F.col("complete_at"), F.lit(False))
    seen = _milestone_rows(events, shakes).groupBy("conn_id").agg(
        F.min(F.when(~after, at)).alias("early_at"),
        F.min(F.when(after & (F.col("event") == "client_hello"), at)).alias("client_hello_at"),
        F.min(F.when(after & (F.col("event") == "server_hello"), at)).alias("server_hello_at"),
    )

    def before_early(fault: str, fault_at: str) -> Column:
        return F.col(fault).isNotNull() & (F.col(fault_at) < F.col("early_at"))

    # a milestone is looked at only while nothing has discarded the flow yet
    early = F.col("early_at").isNotNull() & ~before_early("synack_fault", "synack_at") & ~before_early("ack_fault", "ack_at")
    joined = shakes.join(seen, "conn_id", "left").withColumn("hello_fault", F.when(early, F.lit(INCOMPLETE)))
    faultless = F.col("synack_fault").isNull() & F.col("ack_fault").isNull() & F.col("hello_fault").isNull()
    return joined.withColumn("watched", faultless & F.col("complete_at").isNotNull()).drop("early_at")


def watched_packets(events: DataFrame, shakes: DataFrame) -> DataFrame:
    """Packets with payload that come after the handshake of a watched connection.

    The join with the handshakes would bring all packets of a connection into one task, so connections too
    large for that, at most MAX_HOT of them, are joined by broadcast.
    """
    packets = events.where(F.col("len") > 0).select(
        "conn_id", "arrival", "ts", "is_orig", "seq", "len", F.substring(F.hex("payload_prefix"), 1, 6).alias("head")
    )
    marks = shakes.where("watched").select("conn_id", "complete_at", "client_hello_at", "server_hello_at")
    hot = hot_keys(events, "conn_id", chunk_rows(events.sparkSession))
    if hot:
        is_hot = F.col("conn_id").isin(hot)
        joined = packets.where(is_hot).join(F.broadcast(marks.where(is_hot)), "conn_id").unionByName(
            packets.where(~is_hot).join(marks.where(~is_hot), "conn_id")
        )
    else:
        joined = packets.join(marks, "conn_id")
    return joined.where(F.col("arrival") > F.col("complete_at"))


def data_packets(events: DataFrame, shakes: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The first `horizon` watched packets of each connection, numbered by arrival (`pos` from 0).

    Later ones cannot matter. Spark cuts each map task's share of a connection to that many rows before
    the shuffle, so the length of a connection does not show in any task.
    """
    ordered = W.partitionBy("conn_id").orderBy("arrival")
    numbered = watched_packets(events, shakes).withColumn("_rn", F.row_number().over(ordered)).where(F.col("_rn") <= horizon)
    return numbered.withColumn("pos", F.col("_rn") - 1).drop("_rn")


def judged_packets(packets: DataFrame) -> DataFrame:
    """Adds `fault`, the rule a packet breaks on its own, rules taken in their order:
    sequence continuity per direction, first packet, time order, application data before the hellos."""
    flow = W.partitionBy("conn_id").orderBy("arrival")
    one_way = W.partitionBy("conn_id", "is_orig").orderBy("arrival")
    expected = F.lag(F.col("seq") + F.col("len")).over(one_way)
    first = F.col("pos") == 0
    application = F.col("head").rlike(APPLICATION_RECORD)

    def unset(at: str) -> Column:
        return F.coalesce(F.col(at) >= F.col("arrival"), F.lit(True))

    fault = (
        F.when(F.col("_expected").isNotNull() & (F.col("_expected") != F.col("seq")), F.lit(BAD_SEQUENCE))
        .when(first & (~F.col("is_orig") | ~F.coalesce(F.col("head"), F.lit("")).rlike(HANDSHAKE_RECORD)), F.lit(NO_CLIENT_HELLO))
        .when(~first & (F.col("ts") < F.col("_before")), F.lit(OUT_OF_ORDER))
        .when(~first & application & unset("client_hello_at"), F.lit(NO_CLIENT_HELLO))
        .when(~first & application & unset("server_hello_at"), F.lit(NO_SERVER_HELLO))
    )
    # a hello fault is noticed on a packet that is still taken in; the other faults reject their packet
    kept = ~first & application & F.col("fault").isin(NO_CLIENT_HELLO, NO_SERVER_HELLO)
    return (
        packets.withColumn("_expected", expected)
        .withColumn("_before", F.lag("ts").over(flow))
        .withColumn("fault", fault)
        .withColumn("fault_kept", F.coalesce(kept, F.lit(False)))
        .drop("_expected", "_before")
    )


def clean_prefix(judged: DataFrame) -> DataFrame:
    """Packets taken in: those before the first fault, with that packet too if its fault keeps it."""
    whole = W.partitionBy("conn_id")
    broken = F.col("fault").isNotNull()
    marked = judged.withColumn("_stop", F.min(F.when(broken, F.struct("pos", "arrival", "fault"))).over(whole))
    stop = F.col("_stop.pos")
    taken = stop.isNull() | (F.col("pos") < stop) | ((F.col("pos") == stop) & F.col("fault_kept"))
    return marked.withColumn("taken", taken).withColumn("reason", F.col("_stop.fault")).withColumn(
        "stop_at", F.col("_stop.arrival")
    ).drop("_stop")


def _equal(reason: str):
    return lambda x: x == F.lit(reason)


def final_flows(outcomes: DataFrame, marks: DataFrame) -> DataFrame:
    """The final check: flows handed to it that have all marks in order."""
    complete = (
        F.col("client_hello").isNotNull() & F.col("server_hello").isNotNull() & F.col("ssl_est").isNotNull()
        & (F.col("syn_ts") <= F.col("synack_ts")) & (F.col("synack_ts") <= F.col("ack_ts"))
        & (F.col("len") - 1 > F.col("ssl_est"))
    )
    return outcomes.where(F.col("ending") == SUCCESS).join(marks, "conn_id").where(complete).select(
        "conn_id", "syn_ts", "synack_ts", "ack_ts", "version", "client_hello", "server_hello", "ssl_est", "len"
    )


@dataclass(frozen=True)
class Assembly:
    """Result of an assembly: flows and packets as in the logs, and one row per connection on how it ended."""

    flows: DataFrame
    packets: DataFrame
    outcomes: DataFrame
    marks: DataFrame | None = None

    def counted_flows(self) -> tuple[DataFrame, Observation]:
        """The flows, and an observation that has the number of each reason once they have been written: no pass of its own."""
        seen = Observation()
        ways = F.array("synack_fault", "ack_fault", "hello_fault", "reason", "ending")
        counts = [F.sum(F.size(F.filter(ways, _equal(r)))).alias(r) for r in REASONS]
        return final_flows(self.outcomes.observe(seen, *counts), self.marks), seen

    def reasons(self) -> DataFrame:
        """(reason, n). A flow can count twice: for what ended it, and as success when its prefix was
        handed to the final check. That check comes after counting."""
        listed = self.outcomes.select(F.explode(F.array_compact(F.array(
            "synack_fault", "ack_fault", "hello_fault", "reason", "ending"))).alias("reason"))
        return listed.groupBy("reason").agg(F.count("*").alias("n"))


def assemble(events: DataFrame, allow_shorter: bool = True, horizon: int = HORIZON) -> Assembly:
    """Flows, packets and outcomes. Handshakes and judged packets (at most `horizon` per connection) are
    settled, so that writing all three results reads the events three times and no more."""
    shakes = settled(checked_handshakes(events), "handshakes")
    marked = settled(clean_prefix(judged_packets(data_packets(events, shakes, horizon))), "judged")
    # the array holds at most `horizon` arrivals
    ends = marked.groupBy("conn_id").agg(
        F.count_if("taken").alias("len"),
        F.first("reason").alias("reason"),
        F.min("stop_at").alias("stop_at"),
        F.sort_array(F.collect_list(F.when(F.col("taken"), F.col("arrival")))).alias("arrivals"),
    )
    n = F.col("len")
    short = (n > 0) & (n < horizon)
    ending = F.when((n == horizon) | (short & F.lit(allow_shorter)), F.lit(SUCCESS)).when(short, F.lit(TOO_SHORT))
    ends = ends.withColumn("ending", ending)
    # a milestone counts the packets taken in so far; nothing counts once the flow has ended
    last = F.coalesce(F.col("stop_at"), F.when(n == horizon, F.try_element_at(F.col("arrivals"), F.lit(-1))))
    rows = _milestone_rows(events, shakes.where("watched")).select("conn_id", "arrival", "event", "version").join(
        ends.select("conn_id", "arrivals", last.alias("last_at")), "conn_id"
    )
    so_far = F.size(F.filter("arrivals", lambda a: a <= F.col("arrival"))) - 1
    rows = rows.withColumn("at", so_far)
    counts = (F.col("last_at").isNull() | (F.col("arrival") < F.col("last_at"))) & (F.col("at") >= 0)

    def mark(name: str) -> Column:
        return F.max(F.when(counts & (F.col("event") == name), F.col("at"))).alias(name)

    established = counts & (F.col("event") == "ssl_est")
    marks = rows.groupBy("conn_id").agg(
        *[mark(m) for m in MILESTONES],
        F.max_by(F.when(established, F.col("version")), F.when(established, F.col("arrival"))).alias("version"),
    )
    outcomes = shakes.join(ends.drop("arrivals", "stop_at"), "conn_id", "left")
    flows = final_flows(outcomes, marks)
    packets = marked.where("taken").join(flows.select("conn_id"), "conn_id", "left_semi").select(
        "conn_id", F.col("pos").alias("idx"), "ts", F.col("is_orig").cast("int").alias("direction"),
        F.col("len").cast("int").alias("size"),
    )
    return Assembly(flows, packets, outcomes, marks)
