"""TCP connections: roles, states, and the byte streams of both directions."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

#: Bytes kept of one direction; more makes the stream incomplete.
MOST_BYTES = 16 * 1024 * 1024
#: Microseconds without a segment after which a connection is over.
IDLE_US = 300_000_000

FIN, SYN, RST, ACK = 1, 2, 4, 16
TO_SERVER, TO_CLIENT = "to_server", "to_client"
#: States in which a connection counts as complete.
ENDED = ("closed", "time_wait", "reset")


@dataclass(frozen=True)
class Segment:
    """One TCP segment; ``forward`` tells whether it goes from endpoint a to endpoint b."""

    frame: int
    ts: int | None
    forward: bool
    seq: int
    flags: int
    payload: bytes


def next_state(state: str, flags: int, to_server: bool) -> str:
    """State after a segment: the usual life of a connection as an onlooker sees it."""
    syn, ack, fin = bool(flags & SYN), bool(flags & ACK), bool(flags & FIN)
    if flags & RST:
        return "reset"
    if state == "syn_sent":
        return "syn_received" if syn and ack and not fin and not to_server else state
    if syn:
        return state
    if fin:
        if state == "established":
            return "fin_wait_1" if to_server else "close_wait"
        return {"close_wait": "last_ack", "fin_wait_2": "time_wait", "fin_wait_1": "closing"}.get(state, state)
    if not ack:
        return state
    if state == "syn_received":
        return "established" if to_server else state
    return {"fin_wait_1": "fin_wait_2", "last_ack": "closed", "closing": "time_wait", "mid_stream": "established"}.get(state, state)


@dataclass
class Stream:
    """The bytes of one direction in order, with the frame that made each of them available."""

    limit: int = MOST_BYTES
    start: int | None = None  # sequence number of the first byte, in the unwrapped count
    data: bytearray = field(default_factory=bytearray)
    marks: list[tuple[int, int]] = field(default_factory=list)  # (end offset, frame)
    waiting: dict[int, tuple[bytes, int]] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    held: int = 0
    segments: int = 0
    retransmits: int = 0
    reordered: int = 0
    cut: bool = False
    finished: bool = False
    pinned: bool = False
    last: int = 0

    def unwrapped(self, seq: int) -> int:
        """The 32-bit number as the nearest one to what was seen last."""
        delta = (seq - self.last) & 0xFFFFFFFF
        return self.last + (delta - (1 << 32) if delta >= 1 << 31 else delta)

    def add(self, seq: int, flags: int, payload: bytes, frame: int) -> None:
        if self.start is None:
            # numbers start high enough that an earlier segment never becomes negative
            self.last = seq + (1 << 33)
            self.start = self.last + (1 if flags & SYN else 0)
            self.pinned = bool(flags & SYN)
        at = self.unwrapped(seq)
        self.last = max(self.last, at)
        if flags & SYN:
            at += 1
            if not self.pinned and not self.data:
                self.start, self.pinned = at, True
        if flags & FIN:
            self.finished = True
        if not payload:
            return
        self.segments += 1
        if at < self.start and not self.pinned:
            # the capture began in the middle and an earlier piece comes late
            self._rebase(at)
        nxt = self.start + len(self.data)
        if at + len(payload) <= nxt:
            self.retransmits += 1
            return
        if at < nxt:
            payload, at = payload[nxt - at :], nxt
        if at > nxt:
            self.reordered += 1
            if at in self.waiting and len(self.waiting[at][0]) >= len(payload):
                self.retransmits += 1
                return
            if self.held + len(payload) > self.limit:
                self.cut = True
                return
            if at not in self.waiting:
                insort(self.order, at)
            self.held += len(payload) - len(self.waiting.get(at, (b"",))[0])
            self.waiting[at] = (payload, frame)
            return
        self._append(payload, frame)
        while self.order and self.order[0] <= self.start + len(self.data):
            at = self.order.pop(0)
            piece, _ = self.waiting.pop(at)
            self.held -= len(piece)
            if (skip := self.start + len(self.data) - at) < len(piece):
                self._append(piece[skip:], frame)

    def _rebase(self, at: int) -> None:
        if self.data:
            insort(self.order, self.start)
            self.waiting[self.start] = (bytes(self.data), self.marks[-1][1])
            self.held += len(self.data)
            self.data, self.marks = bytearray(), []
        self.start = at

    def _append(self, payload: bytes, frame: int) -> None:
        room = self.limit - len(self.data)
        if len(payload) > room:
            self.cut = True
            payload = payload[:room]
        if payload:
            self.data += payload
            self.marks.append((len(self.data), frame))

    def frame_of(self, offset: int) -> int | None:
        """The frame that made the byte before ``offset`` available."""
        k = bisect_left(self.marks, (offset, -1))
        return self.marks[k][1] if k < len(self.marks) else None

    @property
    def gaps(self) -> int:
        """Stretches that are missing in front of bytes that wait."""
        n, end = 0, (self.start or 0) + len(self.data)
        for at in self.order:
            n += at > end
            end = max(end, at + len(self.waiting[at][0]))
        return n

    @property
    def complete(self) -> bool:
        return not self.cut and not self.order and self.finished


@dataclass
class Connection:
    """What is known of one connection; endpoint a is the smaller of the two."""

    a: tuple[str, int]
    b: tuple[str, int]
    state: str = ""
    client_is_a: bool = True
    start: int | None = None
    last: int | None = None
    first_frame: int = 0
    last_frame: int = 0
    packets: list[int] = field(default_factory=lambda: [0, 0])
    bytes: list[int] = field(default_factory=lambda: [0, 0])
    streams: tuple[Stream, Stream] = field(default_factory=lambda: (Stream(), Stream()))
    ended_at: int | None = None

    def add(self, s: Segment) -> None:
        if not self.state:
            if s.flags & SYN and not s.flags & ACK:
                self.state, self.client_is_a = "syn_sent", s.forward
            else:
                # begun before the capture: the higher port is the client's
                self.state, self.client_is_a = "mid_stream", self.a[1] > self.b[1]
            self.start, self.first_frame = s.ts, s.frame
        to_server = s.forward == self.client_is_a
        k = 0 if to_server else 1
        self.packets[k] += 1
        self.bytes[k] += len(s.payload)
        self.last, self.last_frame = s.ts, s.frame
        self.state = next_state(self.state, s.flags, to_server)
        if self.state in ENDED and self.ended_at is None:
            self.ended_at = s.ts
        self.streams[k].add(s.seq, s.flags, s.payload, s.frame)

    @property
    def client(self) -> tuple[str, int]:
        return self.a if self.client_is_a else self.b

    @property
    def server(self) -> tuple[str, int]:
        return self.b if self.client_is_a else self.a

    def row(self) -> dict:
        return {
            "client_ip": self.client[0], "server_ip": self.server[0], "client_port": self.client[1], "server_port": self.server[1], "state": self.state, "start_time": self.start, "end_time": self.ended_at,
            "duration_us": self.last - self.start if self.last is not None and self.start is not None else None, "first_frame": self.first_frame, "last_frame": self.last_frame, "packets_to_server": self.packets[0],
            "packets_to_client": self.packets[1], "bytes_to_server": self.bytes[0], "bytes_to_client": self.bytes[1], "is_complete": self.state in ENDED,
        }

    def stream_rows(self) -> list[dict]:
        return [
            {
                "direction": d, "payload": bytes(s.data), "payload_length": len(s.data), "is_complete": s.complete, "gap_count": s.gaps, "segment_count": s.segments, "retransmit_count": s.retransmits,
                "out_of_order_count": s.reordered,
            }
            for d, s in zip((TO_SERVER, TO_CLIENT), self.streams, strict=True)
            if s.segments
        ]


