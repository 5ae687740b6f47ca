"""Assembly against a plain walk over the events, one connection at a time."""

import random
from collections import Counter

import pytest

from seqdrift.operators import assemble as A
from seqdrift.schema import PACKET_EVENTS
from seqdrift.session import shared_dir
from seqdrift.streaming import assembler as ST
from seqdrift.streaming.connection import Connection


def walk(events, allow_shorter, horizon):
    """The rules, event by event: (flow or None, packets, reasons)."""
    first_sa = min((e["arrival"] for e in events if e["flags"] == "SA" and not e["is_orig"]), default=None)
    first_ack = min((e["arrival"] for e in events if e["is_orig"] and "A" in e["flags"]), default=None)
    syns = [e["arrival"] for e in events if e["flags"] == "S" and e["is_orig"]]
    if not syns:
        return None, [], Counter()
    events = [e for e in sorted(events, key=lambda e: e["arrival"]) if e["arrival"] >= max(syns)]
    rec = {"syn_ts": events[0]["ts"], "synack_ts": None, "ack_ts": None, "version": None,
           "client_hello": None, "server_hello": None, "ssl_est": None}
    packets, reasons, expected, logged, written = [], Counter(), {}, False, None

    def discard(reason):
        nonlocal logged
        logged = True
        reasons[reason] += 1

    def log():
        nonlocal written
        discard(A.SUCCESS)
        ok = all(rec[k] is not None for k in ("synack_ts", "ack_ts", "client_hello", "server_hello", "ssl_est"))
        if ok and rec["syn_ts"] <= rec["synack_ts"] <= rec["ack_ts"] and len(packets) - 1 > rec["ssl_est"]:
            written = dict(rec, len=len(packets))

    for e in events[1:]:
        if e["arrival"] == first_sa:
            rec["synack_ts"] = e["ts"]
            if rec["syn_ts"] > e["ts"]:
                discard(A.SYNACK_BEFORE_SYN)
        if e["arrival"] == first_ack:
            rec["ack_ts"] = e["ts"]
            if rec["synack_ts"] is None:
                discard(A.MISSED_SYNACK)
            elif rec["synack_ts"] > e["ts"]:
                discard(A.ACK_BEFORE_SYNACK)
        complete = rec["synack_ts"] is not None and rec["ack_ts"] is not None
        handshake = e["arrival"] in (first_sa, first_ack)
        if e["len"] > 0 and complete and not logged and not handshake:
            way = e["is_orig"]
            prefix = (e["payload_prefix"] or b"")[:3].hex()
            if expected.get(way, e["seq"]) != e["seq"]:
                discard(A.BAD_SEQUENCE)
            else:
                expected[way] = e["seq"] + e["len"]
                if not packets and (not way or prefix not in ("160300", "160301", "160302", "160303")):
                    discard(A.NO_CLIENT_HELLO)
                elif packets and e["ts"] < packets[-1][0]:
                    discard(A.OUT_OF_ORDER)
                else:
                    if packets and prefix in ("170300", "170301", "170302", "170303"):
                        if rec["client_hello"] is None:
                            discard(A.NO_CLIENT_HELLO)
                        elif rec["server_hello"] is None:
                            discard(A.NO_SERVER_HELLO)
                    packets.append((e["ts"], int(way), e["len"]))
                    if len(packets) == horizon:
                        log()
        if e["event"] in A.MILESTONES and not logged:
            if not complete:
                discard(A.INCOMPLETE)
            elif packets:
                rec[e["event"]] = len(packets) - 1
                if e["event"] == "ssl_est":
                    rec["version"] = e["version"]
    if 0 < len(packets) < horizon:
        log() if allow_shorter else discard(A.TOO_SHORT)
    return written, packets if written else [], reasons


def connection(rng, name):
    """A mostly well-behaved connection with faults here and there."""
    rows, ts, seq = [], 100.0, {True: 10, False: 70}

    def add(**kw):
        nonlocal ts
        ts += rng.choice([0.0, 0.25, 0.5])
        row = dict(conn_id=name, ts=ts, is_orig=True, flags="PA", seq=0, len=0, payload_prefix=None, event=None, version=None)
        rows.append({**row, **kw})

    if rng.random() < 0.95:
        add(flags="S")
        if rng.random() < 0.15:
            add(flags="S")
    if rng.random() < 0.93:
        add(flags="SA", is_orig=False, **({"ts": 90.0} if rng.random() < 0.08 else {}))
    if rng.random() < 0.06:
        add(event="client_hello", flags="PA", is_orig=False)
    add(flags="A", **({"ts": 95.0} if rng.random() < 0.08 else {}))
    total = rng.randrange(0, 14)
    marks = {0: "client_hello", 1: "server_hello", 2: "ssl_est"}
    for i in range(total):
        way = True if i == 0 else rng.random() < 0.5
        size = rng.randrange(1, 9)
        jump = 1 if rng.random() < 0.04 else 0
        record = b"\x16\x03\x01" if i < 3 else b"\x17\x03\x03"
        if rng.random() < 0.04:
            record = b"\x17\x03\x02" if rng.random() < 0.5 else b"\x00\x00"
        event = marks.get(i) if rng.random() < 0.93 else None
        late = {"ts": ts - 5.0} if rng.random() < 0.03 else {}
        extra = rng.random() < 0.1
        add(is_orig=way, seq=seq[way] + jump, len=size, payload_prefix=record, event=None if extra else event,
            version="TLSv13" if event == "ssl_est" else None, **late)
        if extra:  # the milestone comes on a row of its own, after the packet
            add(is_orig=False, event=event, version="TLSv12" if event == "ssl_est" else None)
        if rng.random() < 0.1:
            add(is_orig=way, flags="A")
        seq[way] += size + jump
    for i, row in enumerate(rows):
        row["arrival"] = i
    return rows


@pytest.fixture(scope="module")
def connections():
    rng = random.Random(11)
    return {f"c{i:03d}": connection(rng, f"c{i:03d}") for i in range(300)}


def frame(spark, rows):
    names = PACKET_EVENTS.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PACKET_EVENTS)


def expected(connections, allow_shorter, horizon):
    flows, packets, reasons = {}, {}, Counter()
    for name, rows in connections.items():
        flow, taken, why = walk(rows, allow_shorter, horizon)
        reasons += why
        if flow:
            flows[name] = flow
            packets.update({(name, i): p for i, p in enumerate(taken)})
    return flows, packets, reasons


def check(flows, packets, reasons, want):
    keys = ("syn_ts", "synack_ts", "ack_ts", "version", "client_hello", "server_hello", "ssl_est", "len")
    assert {r["conn_id"]: {k: r[k] for k in keys} for r in flows.collect()} == want[0]
    assert {(r["conn_id"], r["idx"]): (r["ts"], r["direction"], r["size"]) for r in packets.collect()} == want[1]
    assert {r["reason"]: r["n"] for r in reasons.collect()} == dict(want[2])


@pytest.mark.parametrize("allow_shorter,horizon", [(True, 50), (True, 6), (False, 6)])
def test_against_a_walk(spark, connections, allow_shorter, horizon):
    want = expected(connections, allow_shorter, horizon)
    assert len(want[0]) > 20 or not allow_shorter
    got = A.assemble(frame(spark, [r for rows in connections.values() for r in rows]), allow_shorter, horizon)
    check(got.flows, got.packets, got.reasons(), want)


def applied(rows, horizon=50):
    connection, packets = Connection(), []
    for e in sorted(rows, key=lambda e: e["arrival"]):
        void, packet = connection.apply(dict(e, head=(e["payload_prefix"] or b"")[:3].hex().upper()), horizon)
        packets = ([] if void else packets) + ([packet] if packet else [])
    return connection, packets


@pytest.mark.parametrize("allow_shorter,horizon", [(True, 50), (True, 6), (False, 6)])
def test_event_by_event(connections, allow_shorter, horizon):
    for name, rows in connections.items():
        flow, taken, why = walk(rows, allow_shorter, horizon)
        connection, packets = applied(rows, horizon)
        assert Counter(connection.reasons(allow_shorter, horizon)) == why, name
        assert connection.flow(allow_shorter, horizon) == (flow or None), name
        assert packets == taken or not flow
        assert Connection(*connection.values()) == connection


def with_end(events):
    last = events[-1]
    return [*events, dict(last, arrival=last["arrival"] + 1, flags="F", len=0, event=ST.END, version=None, payload_prefix=None)]


def shuffled(connections, seed):
    """Connections spread over time, each row up to 30 s late, every tenth row twice, in ten files."""
    rng = random.Random(seed)
    rows = []
    for k, events in enumerate(connections.values()):
        for e in with_end(events):
            row = dict(e, ts=e["ts"] + 7.0 * k)
            rows += [(row["ts"] + rng.random() * 30, row)] * (2 if rng.random() < 0.1 else 1)
    rows = [r for _, r in sorted(rows, key=lambda x: x[0])]
    return [rows[i * len(rows) // 10 : (i + 1) * len(rows) // 10] for i in range(10)]


def moved(connections):
    return {n: [dict(e, ts=e["ts"] + 7.0 * k) for e in rows] for k, (n, rows) in enumerate(connections.items())}


def test_stream_equals_batch_over_shuffled_late_and_repeated_rows(spark, connections):
    some = {k: v for k, v in connections.items() if k < "c060"}
    path, out = shared_dir(spark, "tap"), shared_dir(spark, "out")
    parts = shuffled(some, 3)

    def go_on():
        run = ST.stream_assemble(ST.packet_stream(spark, path, 3), out, f"{out}/checkpoint", delay=60.0, available_now=True)
        run.awaitTermination()
        return run

    for part in parts[:5]:
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    go_on()
    half = ST._ended(spark, out).count()
    # a second run takes up state and sink of the first
    for part in parts[5:]:
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    for ts in (100_000.0, 200_000.0):
        ST.tick(spark, ts).coalesce(1).write.mode("append").parquet(path)
    run = go_on()
    check(*ST.assembled(spark, out), ST.reasons(spark, out), expected(moved(some), True, 50))
    assert 0 < half < ST._ended(spark, out).count()
    # everything has ended, done flags have expired
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


class Handle:
    """State of one key, in memory."""

    def __init__(self):
        self.state, self.timers = {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return State(self.state, name)

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        return self.store.get(self.name, None if self.name == "record" else [])

    def update(self, value):
        self.store[self.name] = value

    put = update

    def appendList(self, rows):  # noqa: N802
        self.store[self.name] = [*self.get(), *rows]

    def clear(self):
        self.store.pop(self.name, None)


def drive(rows, delay=60_000, idle=3_600_000, horizon=50, batch=3):
    """One connection through the processor, a few rows a batch, timers as the watermark passes them."""
    handle, processor = Handle(), ST.Assembler(True, horizon, idle, delay)
    processor.init(handle)
    found, now, most = [], 0, 0
    for i in range(0, len(rows), batch):
        part = [(r["arrival"], int(r["ts"] * 1000), *(r[c] for c in ST.EVENT_FIELDS[2:])) for r in rows[i : i + batch]]
        found += processor._go_on("c", [e for e in part if e[1] >= now], now)
        now = max([now, *(e[1] - delay for e in part)])
        for t in sorted(handle.timers):
            if t < now:
                handle.timers.discard(t)
                found += processor._go_on("c", [], now, t)
        assert len(handle.timers) <= 1
        most = max(most, len(handle.state.get("packets", [])))
    return found, handle, most


def raw(rows):
    return [dict(r, head=(r["payload_prefix"] or b"")[:3].hex()) for r in rows]


def data(i, ts):
    return dict(conn_id="c", arrival=i, ts=ts, is_orig=True, flags="PA", seq=i * 2, len=2, payload_prefix=b"\x16\x03\x01", event=None, version=None)


def opening(ts=100.0):
    rows = [dict(data(i, ts + i), flags=f, is_orig=i != 1, len=0) for i, f in enumerate(("S", "SA", "A"))]
    marks = ("client_hello", "server_hello", "ssl_est")
    return rows + [dict(data(3 + i, ts + 3 + i), event=m, version="TLSv13") for i, m in enumerate(marks)]


def test_fiftieth_packet_ends_a_connection_and_later_rows_open_none():
    rows = raw(opening() + [data(i, 100.0 + i) for i in range(6, 2000)])
    found, handle, most = drive(rows)
    assert len(found) == 1 and found[0].flow["len"] == 50 and len(found[0].packets) == 50 and most <= 50
    # the done flag is all that is left, and it expires
    assert set(handle.state) == {"record"} and handle.state["record"][23] is True
    other = raw([dict(data(9000 + i, 1e6 * (i + 1)), flags="", len=0) for i in range(3)])
    handle = drive(rows, batch=50)[1]
    ST_ = ST.Assembler(True, 50, 3_600_000, 60_000)
    ST_.init(handle)
    (timer,) = handle.timers
    assert list(ST_._go_on("c", [], timer + 1, timer)) == [] and not handle.state
    assert len(drive(rows + other)[0]) == 1


def test_silence_ends_a_connection():
    rows = raw(opening() + [data(i, 100.0 + i) for i in range(6, 12)])
    assert drive(rows)[0] == []
    _, handle, _ = drive(rows)
    processor = ST.Assembler(True, 50, 3_600_000, 60_000)
    processor.init(handle)
    found, now = [], 111_000
    for _ in range(3):  # other connections move the watermark on
        (timer,) = handle.timers or {None}
        now = max(now, timer + 1)
        handle.timers.discard(timer)
        found += processor._go_on("c", [], now, timer)
    assert [r.flow["len"] for r in found] == [9] and now > 111_000 + 3_600_000 and not handle.state


def test_rows_of_any_order_within_the_delay():
    rng = random.Random(5)
    rows = raw(with_end(opening() + [data(i, 100.0 + i) for i in range(6, 30)])) + raw([dict(data(999, 1e5), flags="", len=0)])
    want = drive(rows)[0]
    assert len(want) == 1 and want[0].flow["len"] == 27
    for _ in range(20):
        body = rows[:-1]
        rng.shuffle(body)
        body += rng.sample(body, 5)
        assert drive([*body, rows[-1]], batch=rng.randrange(1, 9))[0] == want
