"""Builders of packets and capture files, for round trips and tests."""

from __future__ import annotations

import ipaddress
import struct

MAC_A, MAC_B = bytes.fromhex("020000000001"), bytes.fromhex("020000000002")


def eth(payload: bytes, kind: int = 0x0800) -> bytes:
    return MAC_B + MAC_A + struct.pack(">H", kind) + payload


def ip(payload: bytes, proto: int, src: str = "192.168.1.100", dst: str = "192.168.1.200", ttl: int = 64, frag: int = 0x4000) -> bytes:
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 7, frag, ttl, proto, 0) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + payload


def ip6(payload: bytes, nxt: int, src: str = "2001:db8::1", dst: str = "2001:db8::2", hops: int = 64) -> bytes:
    return struct.pack(">IHBB", 6 << 28, len(payload), nxt, hops) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + payload


def tcp(sport: int, dport: int, seq: int = 1, ack: int = 0, flags: int = 2, payload: bytes = b"", options: bytes = b"") -> bytes:
    options += bytes(-len(options) % 4)
    return struct.pack(">HHIIHHHH", sport, dport, seq & 0xFFFFFFFF, ack, ((5 + len(options) // 4) << 12) | flags, 65535, 0, 0) + options + payload


def udp(sport: int, dport: int, payload: bytes) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def name(text: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in text.split(".")) + b"\0"


def dns_query(host: str, kind: int = 1, ident: int = 0x1234) -> bytes:
    return struct.pack(">HHHHHH", ident, 0x0100, 1, 0, 0, 0) + name(host) + struct.pack(">HH", kind, 1)


def dns_answer(host: str, ident: int = 0x1234) -> bytes:
    out = struct.pack(">HHHHHH", ident, 0x8180, 1, 3, 0, 1) + name(host) + struct.pack(">HH", 1, 1)
    for kind, data in ((5, name("alias.test")), (1, bytes([10, 0, 0, 7])), (28, ipaddress.ip_address("2001:db8::7").packed)):
        out += b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, 300, len(data)) + data
    return out + b"\0" + struct.pack(">HHIH", 41, 1232, 0, 0)


def extension(kind: int, data: bytes) -> bytes:
    return struct.pack(">HH", kind, len(data)) + data


def client_hello(random: bytes, host: str = "www.test", ciphers: tuple[int, ...] = (0x0A0A, 0x1301, 0xC02F), alpn: bytes = b"h2") -> bytes:
    sni = extension(0, struct.pack(">HBH", len(host) + 3, 0, len(host)) + host.encode())
    ext = extension(0x0A0A, b"") + sni + extension(10, struct.pack(">HHH", 4, 0x0A0A, 29)) + extension(11, b"\1\0") + extension(16, struct.pack(">HB", len(alpn) + 1, len(alpn)) + alpn)
    body = b"\3\3" + random + b"\0" + struct.pack(">H", 2 * len(ciphers)) + b"".join(struct.pack(">H", c) for c in ciphers) + b"\1\0" + struct.pack(">H", len(ext)) + ext
    return b"\1" + len(body).to_bytes(3, "big") + body


def server_hello(random: bytes, cipher: int, tls13: bool = False) -> bytes:
    ext = extension(43, b"\3\4") if tls13 else extension(0xFF01, b"\0")
    body = b"\3\3" + random + b"\0" + struct.pack(">HB", cipher, 0) + struct.pack(">H", len(ext)) + ext
    return b"\2" + len(body).to_bytes(3, "big") + body


def record(kind: int, body: bytes, version: int = 0x0303) -> bytes:
    return struct.pack(">BHH", kind, version, len(body)) + body


def pcap_head(link: int, order: str = "<", nano: bool = False) -> bytes:
    return struct.pack(order + "IHHIIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)


def pcap_record(frame: bytes, us: int, order: str = "<", nano: bool = False) -> bytes:
    return struct.pack(order + "IIII", us // 1_000_000, us % 1_000_000 * (1000 if nano else 1), len(frame), len(frame)) + frame


def pcap(frames: list[bytes], link: int = 1, order: str = "<", nano: bool = False, start: int = 1_700_000_000, step_us: int = 1000, times: list[int] | None = None) -> bytes:
    parts = (pcap_record(f, times[i] if times else start * 1_000_000 + i * step_us, order, nano) for i, f in enumerate(frames))
    return pcap_head(link, order, nano) + b"".join(parts)


def block(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 4)
    return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))


def pcapng(frames: list[tuple[int, bytes]], links: list[int], start_us: int = 1_700_000_000_000_000, nano: bool = False) -> bytes:
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    for link in links:
        out += block(1, struct.pack("<HHI", link, 0, 0) + (struct.pack("<HHBxxx", 9, 1, 9) + struct.pack("<HH", 0, 0) if nano else b""))
    for i, (face, data) in enumerate(frames):
        t = (start_us + i * 1000) * (1000 if nano else 1)
        out += block(6, struct.pack("<IIIII", face, t >> 32, t & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


class Talk:
    """A TCP conversation, segment by segment."""

    def __init__(self, client: tuple[str, int] = ("10.0.0.1", 40000), server: tuple[str, int] = ("10.0.0.2", 80), isn: tuple[int, int] = (1000, 5000)) -> None:
        self.ends, self.seq, self.frames = (client, server), list(isn), []

    def send(self, side: int, payload: bytes = b"", flags: int = 16, seq: int | None = None) -> Talk:
        (sip, sport), (dip, dport) = self.ends[side], self.ends[1 - side]
        self.frames.append(eth(ip(tcp(sport, dport, self.seq[side] if seq is None else seq, self.seq[1 - side], flags, payload), 6, sip, dip)))
        if seq is None:
            self.seq[side] += len(payload) + (1 if flags & 3 else 0)
        return self

    def open(self) -> Talk:
        return self.send(0, flags=2).send(1, flags=18).send(0)

    def close(self) -> Talk:
        return self.send(0, flags=17).send(1).send(1, flags=17).send(0)
