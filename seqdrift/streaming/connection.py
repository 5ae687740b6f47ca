"""One connection as events reach it in the order of arrival: the rules of `operators.assemble`, event by event.

Small enough to live in the state of a stream. The batch operators remain the definition; tests hold both against each other.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from seqdrift.operators import assemble as A
from seqdrift.schema import HORIZON

#: event that marks the end of a connection
END = "end"
_HANDSHAKE = tuple(f"16030{i}" for i in range(4))
_APPLICATION = tuple(f"17030{i}" for i in range(4))


@dataclass
class Connection:
    """What later events need of the earlier ones. Packets taken in are handed out by `apply`, not kept here."""

    last_arrival: int | None = None
    syn_at: int | None = None
    syn_ts: float | None = None
    sa_at: int | None = None
    sa_ts: float | None = None
    ack_at: int | None = None
    ack_ts: float | None = None
    synack_fault: str | None = None
    ack_fault: str | None = None
    hello_fault: str | None = None
    complete_at: int | None = None
    taken: int = 0
    looked_at: int = 0
    next_orig: int | None = None
    next_resp: int | None = None
    before: float | None = None
    client_hello_seen: bool = False
    server_hello_seen: bool = False
    client_hello: int | None = None
    server_hello: int | None = None
    ssl_est: int | None = None
    version: str | None = None
    fault: str | None = None
    over: bool = False

    def apply(self, e: dict, horizon: int = HORIZON) -> tuple[bool, tuple | None]:
        """Takes in one event. Says whether packets held so far are void (a SYN opened the record anew), and the packet
        (ts, direction, size) to keep, if any. Events must come by arrival; one that came before is passed over."""
        at = e["arrival"]
        if self.over or self.last_arrival is not None and at <= self.last_arrival:
            return False, None
        self.last_arrival = at
        void = self._flags(at, e)
        packet = self._packet(at, e, horizon)
        self._milestone(at, e, horizon)
        if e["event"] == END or self.taken == horizon:
            self.over = True
        return void, packet

    def _flags(self, at: int, e: dict) -> bool:
        flags = e["flags"] or ""
        if flags == "S" and e["is_orig"]:
            # establishment and first ACK count once, be they before or after
            again = Connection(last_arrival=at, syn_at=at, syn_ts=e["ts"], sa_at=self.sa_at, ack_at=self.ack_at)
            void = self.taken > 0
            self.__dict__.update(again.__dict__)
            return void
        if flags == "SA" and e["is_orig"] is False and self.sa_at is None:
            self.sa_at = at
            if self.syn_at is not None:
                self.sa_ts = e["ts"]
                if self.syn_ts > self.sa_ts:
                    self.synack_fault = A.SYNACK_BEFORE_SYN
        if e["is_orig"] and "A" in flags and self.ack_at is None:
            self.ack_at = at
            if self.syn_at is not None:
                self.ack_ts = e["ts"]
                if self.sa_ts is None:
                    self.ack_fault = A.MISSED_SYNACK
                elif self.sa_ts > self.ack_ts:
                    self.ack_fault = A.ACK_BEFORE_SYNACK
        if self.complete_at is None and self.sa_ts is not None and self.ack_ts is not None:
            self.complete_at = at
        return False

    @property
    def watched(self) -> bool:
        return self.complete_at is not None and not (self.synack_fault or self.ack_fault or self.hello_fault) and self.fault is None

    def _packet(self, at: int, e: dict, horizon: int) -> tuple | None:
        if not (e["len"] or 0) > 0 or not self.watched or at <= self.complete_at:
            return None
        head, first, orig, ts = (e["head"] or "").lower(), self.looked_at == 0, bool(e["is_orig"]), e["ts"]
        expected = self.next_orig if orig else self.next_resp
        self.looked_at += 1
        application = not first and head.startswith(_APPLICATION)
        kept = True
        if expected is not None and e["seq"] is not None and expected != e["seq"]:
            self.fault, kept = A.BAD_SEQUENCE, False
        elif first and (not orig or not head.startswith(_HANDSHAKE)):
            self.fault, kept = A.NO_CLIENT_HELLO, False
        elif not first and None not in (ts, self.before) and ts < self.before:
            self.fault, kept = A.OUT_OF_ORDER, False
        elif application and not self.client_hello_seen:
            self.fault = A.NO_CLIENT_HELLO
        elif application and not self.server_hello_seen:
            self.fault = A.NO_SERVER_HELLO
        if not kept:
            return None
        following = None if e["seq"] is None else e["seq"] + e["len"]
        if orig:
            self.next_orig = following
        else:
            self.next_resp = following
        self.before = ts
        self.taken += 1
        return ts, int(orig), int(e["len"])

    def _milestone(self, at: int, e: dict, horizon: int) -> None:
        name = e["event"]
        if name not in A.MILESTONES or self.syn_at is None:
            return
        if self.complete_at is None:
            # looked at only while nothing has discarded the flow
            discarded = self.synack_fault and self.sa_at < at or self.ack_fault and self.ack_at < at
            if not discarded:
                self.hello_fault = self.hello_fault or A.INCOMPLETE
            return
        if name == "client_hello":
            self.client_hello_seen = True
        elif name == "server_hello":
            self.server_hello_seen = True
        if not self.watched or self.taken == 0 or self.taken >= horizon:
            return
        setattr(self, name, self.taken - 1)
        if name == "ssl_est":
            self.version = e["version"]

    def reasons(self, allow_shorter: bool, horizon: int = HORIZON) -> list[str]:
        """Why the connection ended, as `Assembly.reasons` counts it; nothing without a SYN."""
        if self.syn_at is None:
            return []
        found = [self.synack_fault, self.ack_fault, self.hello_fault, self.fault]
        if self.taken == horizon or 0 < self.taken and allow_shorter:
            found.append(A.SUCCESS)
        elif 0 < self.taken:
            found.append(A.TOO_SHORT)
        return [r for r in found if r]

    def flow(self, allow_shorter: bool, horizon: int = HORIZON) -> dict | None:
        """The row of the flow log, if the connection passes the final check."""
        marks = (self.client_hello, self.server_hello, self.ssl_est)
        if A.SUCCESS not in self.reasons(allow_shorter, horizon) or any(m is None for m in marks):
            return None
        if not self.syn_ts <= self.sa_ts <= self.ack_ts or not self.taken - 1 > self.ssl_est:
            return None
        return dict(syn_ts=self.syn_ts, synack_ts=self.sa_ts, ack_ts=self.ack_ts, version=self.version, client_hello=self.client_hello,
                    server_hello=self.server_hello, ssl_est=self.ssl_est, len=self.taken)

    def values(self) -> tuple:
        return tuple(asdict(self).values())

    @staticmethod
    def schema() -> str:
        kinds = {"int": "long", "float": "double", "str": "string", "bool": "boolean"}
        return ", ".join(f"{f.name} {kinds[f.type.split(' ')[0]]}" for f in fields(Connection))
