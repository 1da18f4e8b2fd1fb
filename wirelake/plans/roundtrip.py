"""Round trips: captures written from the rows of ``orders``, read back through an engine.

Every order key gives one packet, or one conversation, of a kind that the key chooses, with fields that
are arithmetic of the key. The packets are written as capture files into the shared folder, opened as
any capture is, and the tables and views are then compared with the same arithmetic in SQL. What the
bytes of each protocol are is stated twice, here for the packet and in SQL for the row; the decoders
take part in neither.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from pathlib import Path
from tempfile import NamedTemporaryFile
from typing import BinaryIO
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.decode import packets as P
from wirelake.engine import Engine, histogram, stats, time_info, top
from wirelake.plans.views import VIEWS
from wirelake.session import _shared_folder, table
from wirelake.streaming import tls_crypto

#: Kinds of packets; a key is of the kind ``key % KINDS``.
KINDS = 32
BASE_US = 1_700_000_000_000_000
RANDOM, MASTER = bytes(range(32)), bytes(range(48))
KEY_LOG = f"CLIENT_RANDOM {RANDOM.hex()} {MASTER.hex()}\n"


def _a(k: int) -> str:
    return f"10.1.{k // 256 % 256}.{k % 256}"


def _b(k: int) -> str:
    return f"2001:db8::{k % 65536:x}"


def _sport(k: int) -> int:
    return 1024 + k % 40000


def _four(k: int, payload: bytes, proto: int) -> bytes:
    return P.eth(P.ip(payload, proto, _a(k), "192.168.0.1", 32 + k % 64))


def _six(k: int, payload: bytes, nxt: int) -> bytes:
    return P.eth(P.ip6(payload, nxt, _b(k), "2001:db8::ffff", 32 + k % 64), 0x86DD)


def _udp(k: int, port: int, payload: bytes) -> bytes:
    return _four(k, P.udp(_sport(k), port, payload), 17)


def _tcp(k: int, port: int, payload: bytes) -> bytes:
    return _four(k, P.tcp(_sport(k), port, k % 2**32, 7, 24, payload), 6)


def _inner(k: int) -> bytes:
    return P.ip(P.udp(_sport(k), 9, b"in"), 17, "10.9.0.1", f"10.9.0.{2 + k % 200}", 17)


def _arp(k: int) -> bytes:
    return P.eth(struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1 + k // KINDS % 2) + P.MAC_A + struct.pack(">I", 0x0A010000 + k % 65536) + bytes(6) + bytes([10, 0, 0, 2]), 0x0806)


def _options(k: int) -> bytes:
    return _four(k, P.tcp(_sport(k), 8080, k, k + 1, 18, options=b"\x02\x04" + struct.pack(">H", 500 + k % 900) + b"\x03\x03" + bytes([k % 14]) + b"\x04\x02\x08\x0a" + struct.pack(">II", k, k + 5)), 6)


def _mpls(k: int) -> bytes:
    return P.eth(b"".join(((16 + (k + i) % 1000 << 12) | (5 << 9) | ((i == 1) << 8) | 9 + i).to_bytes(4, "big") for i in range(2)) + _inner(k), 0x8847)


def _neighbour(k: int) -> bytes:
    return _six(k, struct.pack(">BBHI", 135, 0, 0, 0) + P.ipaddress.ip_address(f"fe80::{k % 65536:x}").packed + b"\1\1" + P.MAC_A, 58)


def _listener(k: int) -> bytes:
    return _six(k, struct.pack(">BBHHH", 130, 0, 0, k % 10000, 0) + P.ipaddress.ip_address("ff02::1:3").packed, 58)


def _bgp(k: int) -> bytes:
    return _tcp(k, 179, b"\xff" * 16 + struct.pack(">HBBHHIB", 29, 1, 4, k % 60000, 90 + k % 90, 0x0A020000 + k % 65536, 0))


def _ospf(k: int) -> bytes:
    return _four(k, struct.pack(">BBHIIHHQ", 2, 1, 44, 0x01010000 + k % 65536, k % 7, 0, 0, 0) + struct.pack(">IHBBIII", 0xFFFFFF00, 5 + k % 60, 0, 1, 20 + k % 240, 0x0A000001, 0x0A000002), 89)


def _dns(k: int, answer: bool) -> bytes:
    text = P.dns_answer(f"n{k % 977}.Test", k % 65536) if answer else P.dns_query(f"n{k % 977}.Test", 1 + k % 30, k % 65536)
    return _four(k, P.udp(*((53, _sport(k)) if answer else (_sport(k), 53)), text), 17)


def _dhcp(k: int) -> bytes:
    body = bytes([1, 1, 6, k % 9]) + struct.pack(">IHHIIII", k, k % 600, 0x8000, 0, 0x0A030000 + k % 65536, 0, 0) + P.MAC_A + bytes(10) + bytes(192) + b"\x63\x82\x53\x63" + b"\x35\1" + bytes([1 + k % 8])
    return _four(k, P.udp(68, 67, body + b"\x33\4" + struct.pack(">I", k) + b"\x01\4\xff\xff\xff\0\x03\4\x0a\0\0\1\x36\4\x0a\0\0\2\x06\4\x08\x08\x08\x08\xff"), 17)


def _ntp(k: int) -> bytes:
    return _four(k, P.udp(123, 123, bytes([0x23, 2 + k % 10, 6, 0xEC]) + struct.pack(">II", (k % 100) << 16, 1 << 15) + bytes([10, 0, 0, 9]) + bytes(32)), 17)


def _hello(k: int) -> bytes:
    return _tcp(k, 443, P.record(22, P.client_hello(bytes(32), f"s{k % 977}.test")))


def _quic(k: int) -> bytes:
    return _udp(k, 443, bytes([0xC0]) + struct.pack(">I", 1) + b"\x08" + k.to_bytes(8, "big") + b"\x00\x00\x40" + bytes([16 + k % 40]) + bytes(16 + k % 40))


def _netlink(k: int) -> bytes:
    link = struct.pack("<BxHiII", 0, 1, 1 + k % 50, 0x1043, 0) + struct.pack("<HH", 9, 3) + f"eth{k % 10}".encode() + b"\0\0\0\0" + struct.pack("<HHI", 8, 4, 1400 + k % 100)
    return struct.pack("<IHHII", 16 + len(link), 16, 3, k, 77) + link


def _http(k: int) -> list[bytes]:
    body = b"x" * (k % 50)
    request = f"GET /o/{k} HTTP/1.1\r\nHost: h{k % 97}.test\r\nUser-Agent: u{k % 7}\r\n\r\n".encode()
    answer = f"HTTP/1.1 {200 + k // KINDS % 3} Fine\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return P.Talk((_a(k), _sport(k)), ("172.31.0.1", 80)).open().send(0, request, 24).send(1, answer[:30], 24).send(1, answer[30:], 24).close().frames


def _http2_frame(kind: int, flags: int, stream: int, body: bytes = b"") -> bytes:
    return len(body).to_bytes(3, "big") + bytes([kind, flags]) + stream.to_bytes(4, "big") + body


def _sealed(keys: tls_crypto.Keys, kind: int, plain: bytes) -> bytes:
    """A record of TLS 1.2 with AES in Galois mode, as the other side would send it."""
    number = keys.seq.to_bytes(8, "big")
    text, tag = tls_crypto.gcm(keys.key, keys.iv + number, plain, number + bytes([kind]) + b"\3\3" + len(plain).to_bytes(2, "big"), None)
    keys.seq += 1
    return P.record(kind, number + text + tag)


def _secret(k: int) -> list[bytes]:
    """HTTP/2 inside TLS that the key log opens: a request for /, and an answer of some bytes."""
    other = bytes(range(32, 64))
    keys = list(tls_crypto.keys12(0xC02F, MASTER, RANDOM, other))
    done = [P.record(20, b"\1") + _sealed(x, 22, b"\x14\0\0\x0cabcdabcdabcd") for x in keys]
    ask = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n" + _http2_frame(4, 0, 0) + _http2_frame(1, 5, 1, bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff"))
    give = _http2_frame(4, 0, 0) + _http2_frame(1, 4, 1, b"\x88") + _http2_frame(0, 1, 1, b"d" * (1 + k % 60))
    talk = P.Talk((_a(k), _sport(k)), ("172.31.0.2", 443)).open().send(0, P.record(22, P.client_hello(RANDOM, f"t{k % 97}.test")), 24).send(1, P.record(22, P.server_hello(other, 0xC02F)) + done[1], 24)
    return talk.send(0, done[0], 24).send(0, _sealed(keys[0], 23, ask), 24).send(1, _sealed(keys[1], 23, give), 24).frames


def _reset(k: int) -> list[bytes]:
    """Three segments of which the last two change places, then a reset."""
    talk = P.Talk((_a(k), _sport(k)), ("172.31.0.3", 9000)).open().send(0, b"a" * 10, 24).send(0, b"b" * (1 + k % 30), 24).send(0, b"c" * 5, 24).send(1, flags=4)
    f = talk.frames
    return [*f[:4], f[5], f[4], f[4], *f[6:]]


def _idle(k: int) -> list[bytes]:
    return P.Talk((_a(k), _sport(k)), ("172.31.0.4", 901)).open().send(0, b"a", 24).send(0, b"b" * (k % 9), 24).frames


#: Kind -> packets of a key. Those not of Ethernet have their link type beside them.
BUILDERS: dict[int, Callable[[int], bytes | list[bytes]]] = {
    0: _arp, 1: lambda k: P.eth(struct.pack(">HH", (k % 8 << 13) | k % 4095, 0x0800) + _inner(k), 0x8100), 2: _mpls, 3: lambda k: _four(k, b"raw", 253), 4: lambda k: _six(k, b"", 59), 5: _options,
    6: lambda k: _udp(k, 7777, bytes(k % 40)), 7: lambda k: _four(k, struct.pack(">BBHHH", 8, 0, 5, k % 65536, k % 100), 1), 8: _neighbour, 9: _listener,
    10: lambda k: _four(k, struct.pack(">HHI", 0x2000, 0x0800, k) + _inner(k), 47), 11: lambda k: _udp(k, 4789, b"\x08\0\0\0" + (k % 2**24 << 8).to_bytes(4, "big") + P.eth(_inner(k))),
    12: lambda k: _udp(k, 2152, struct.pack(">BBHI", 0x30, 255, len(_inner(k)), k) + _inner(k)), 13: lambda k: _four(k, struct.pack(">II", k, k + 1) + bytes(20), 50),
    14: lambda k: _four(k, struct.pack(">BBHII", 17, 4, 0, k, k + 2) + bytes(12) + P.udp(_sport(k), 9, b"ah"), 51), 15: _bgp, 16: _ospf, 17: lambda k: _dns(k, False), 18: lambda k: _dns(k, True), 19: _dhcp, 20: _ntp, 21: _hello,
    22: lambda k: _tcp(k, 22, f"SSH-2.0-Build_{k % 100} note\r\n".encode()), 23: _quic, 24: lambda k: struct.pack(">HHH8sH", k % 4, 1, 6, P.MAC_A + bytes(2), 0x0800) + _inner(k), 25: _netlink,
    26: lambda k: _six(k, _inner(k), 4), 27: lambda k: _six(k, P.ip6(b"", 59, "fd00::1", f"fd00::{k % 65536:x}", 9), 41), 28: _http, 29: _secret, 30: _reset, 31: _idle,
}
LINKS = {24: 113, 25: 253}
_IDLE_STEP = 400_000_000


def _written(spark: SparkSession, d: str, kinds: tuple[int, ...]) -> str:
    """Folder of the captures of the directory's orders of these kinds, one file a link type and partition."""
    folder = f"{_shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError(f"captures are written to a file system, not to {place.scheme}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that is run again writes the same names, and only what is whole gets a name that is read
        name = f"{TaskContext.get().partitionId():05d}.pcap"
        Path(place.path).mkdir(parents=True, exist_ok=True)
        found: dict[int, BinaryIO] = {}
        with ExitStack() as files:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    kind = k % KINDS
                    made = BUILDERS[kind](k)
                    link = LINKS.get(kind, 1)
                    if link not in found:
                        found[link] = files.enter_context(NamedTemporaryFile(dir=place.path, prefix=".", delete=False))
                        found[link].write(P.pcap_head(link))
                    for i, frame in enumerate(made if isinstance(made, list) else [made]):
                        # the last packet of an idle conversation comes after the idle time
                        found[link].write(P.pcap_record(frame, BASE_US + 1000 * k + i + (_IDLE_STEP if kind == 31 and i == 4 else 0)))
        for link, f in found.items():
            Path(f.name).chmod(0o644)
            Path(f.name).replace(Path(place.path) / f"{link}-{name}")
        yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], ["n"])

    keys = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k")).where((F.col("k") % KINDS).isin(*kinds))
    written = keys.repartition(spark.sparkContext.defaultParallelism, "k").sortWithinPartitions("k").mapInArrow(write, "n long").collect()
    if not sum(r["n"] for r in written):
        Path(place.path).mkdir(parents=True, exist_ok=True)
        (Path(place.path) / "none.pcap").write_bytes(P.pcap([]))
    return place.path


_OPEN: dict[tuple, Engine] = {}


def opened(spark: SparkSession, d: str, kinds: tuple[int, ...] | None = None) -> Engine:
    """The engine over the directory's captures, one for a session, in a session of its own.

    With ``kinds``, the captures hold all packets of these kinds and no others, for a table of packets that
    is read once: its decoders run when it is read, and no tables of streams are made.
    """
    at = spark.sparkContext.applicationId, d, kinds
    if at not in _OPEN:
        path = f"{_written(spark, d, kinds or tuple(BUILDERS))}/*.pcap"
        _OPEN[at] = Engine.open(spark.newSession(), path, streams=False, cache=False, capture_time=False) if kinds else Engine.open(spark.newSession(), path, KEY_LOG)
    return _OPEN[at]


_KEY = f"CAST((unix_micros(CAST(timestamp AS TIMESTAMP)) - {BASE_US}) DIV 1000 AS BIGINT)"
_IP4 = {"src_ip_v4": "167837696 + k % 65536", "dst_ip_v4": "3232235521"}
_PORT = "1024 + k % 40000"
_A = "concat('10.1.', (k // 256) % 256, '.', k % 256)"
_B = "concat('20010DB8', repeat('0', 20), printf('%04X', k % 65536))"
_MACS = {"src_mac": "'020000000001'", "dst_mac": "'020000000002'"}
_INNER = {"src_ip": "168361985", "dst_ip": "168361986 + k % 200", "ttl": "17", "protocol": "17"}


def _quad(n: str, high: str) -> str:
    return f"concat('{high}.', ({n}) // 256, '.', ({n}) % 256)"


#: decoder -> (kinds, depth, columns of its rows in SQL over the key)
DECODED: dict[str, tuple[tuple[int, ...], int, dict[str, str]]] = {
    "ethernet": ((3,), 0, _MACS | {"ethertype": "2048"}),
    "linux_sll": ((24,), 0, {"packet_type": "k % 4", "arphrd_type": "1", "addr_len": "6", "addr": "'020000000001'", "protocol": "2048"}),
    "arp": ((0,), 0, {"hardware_type": "1", "protocol_type": "2048", "hardware_size": "6", "protocol_size": "4", "operation": "1 + (k // 32) % 2", "operation_name": "CASE WHEN (k // 32) % 2 = 0 THEN 'Request' ELSE 'Reply' END", "sender_mac": "'020000000001'", "sender_ip": "167837696 + k % 65536", "target_mac": "'000000000000'", "target_ip": "167772162"}),
    "vlan": ((1,), 0, {"vlan_id": "k % 4095 & 4095", "priority": "((k % 8 << 13) | k % 4095) >> 13", "dei": "(((k % 8 << 13) | k % 4095) & 4096) <> 0", "inner_ethertype": "2048"}),
    "mpls": ((2,), 0, {"label": "16 + k % 1000", "tc": "5", "ttl": "9", "stack_depth": "2", "labels": "concat(16 + k % 1000, ',', 16 + (k + 1) % 1000)"}),
    "ipv4": ((3,), 0, {"version": "4", "ihl": "5", "dscp": "0", "ecn": "0", "total_length": "23", "identification": "7", "dont_fragment": "true", "more_fragments": "false", "fragment_offset": "0", "ttl": "32 + k % 64", "protocol": "253", "checksum": "0", "src_ip": "167837696 + k % 65536", "dst_ip": "3232235521"}),
    "ipv6": ((4,), 0, {"version": "6", "traffic_class": "0", "flow_label": "0", "payload_length": "0", "next_header": "59", "hop_limit": "32 + k % 64", "src_ip": _B, "dst_ip": "concat('20010DB8', repeat('0', 20), 'FFFF')"}),
    "tcp": ((5,), 0, {"src_port": _PORT, "dst_port": "8080", "seq": "k", "ack": "k + 1", "data_offset": "10", "flags": "18", "flag_syn": "true", "flag_ack": "true", "flag_fin": "false", "flag_rst": "false", "flag_psh": "false", "flag_urg": "false", "window": "65535", "checksum": "0", "urgent_ptr": "0", "options_length": "20", "options": "'MSS,WS,SACK_PERM,TS'", "mss": "500 + k % 900", "window_scale": "k % 14", "sack_permitted": "true", "ts_val": "k", "ts_ecr": "k + 5"}),
    "udp": ((6,), 0, {"src_port": _PORT, "dst_port": "7777", "length": "8 + k % 40", "checksum": "0"}),
    "icmp": ((7,), 0, {"type": "8", "code": "0", "checksum": "5", "type_name": "'Echo Request'", "identifier": "k % 65536", "sequence": "k % 100"}),
    "icmpv6": ((8,), 0, {"type": "135", "code": "0", "type_name": "'Neighbor Solicitation'", "ndp_target_address": "concat('FE80', repeat('0', 24), printf('%04X', k % 65536))", "ndp_source_mac": "'020000000001'"}),
    "gre": ((10,), 0, {"checksum_present": "false", "key_present": "true", "sequence_present": "false", "version": "0", "protocol": "2048", "key": "k"}),
    "vxlan": ((11,), 0, {"flags": "8", "vni": "k % 16777216"}),
    "gtp": ((12,), 0, {"version": "1", "protocol_type": "1", "message_type": "255", "length": "30", "teid": "k"}),
    "ipsec": ((13, 14), 0, {"spi": "k", "sequence": "k + CASE WHEN k % 32 = 13 THEN 1 ELSE 2 END", "protocol": "CASE WHEN k % 32 = 13 THEN 'ESP' ELSE 'AH' END", "ah_next_header": "CASE WHEN k % 32 = 14 THEN 17 END", "ah_icv_length": "CASE WHEN k % 32 = 14 THEN 12 END"}),
    "bgp": ((15,), 0, {"message_type": "1", "message_type_name": "'OPEN'", "length": "29", "version": "4", "my_as": "k % 60000", "hold_time": "90 + k % 90", "bgp_id": _quad("k % 65536", "10.2")}),
    "ospf": ((16,), 0, {"version": "2", "message_type": "1", "message_type_name": "'Hello'", "length": "44", "router_id": _quad("k % 65536", "1.1"), "area_id": "concat('0.0.0.', k % 7)", "auth_type": "0", "hello_interval": "5 + k % 60", "dead_interval": "20 + k % 240", "designated_router": "'10.0.0.1'", "backup_dr": "'10.0.0.2'"}),
    "dns": ((17, 18), 0, {"transaction_id": "k % 65536", "is_query": "k % 32 = 17", "opcode": "0", "recursion_desired": "true", "recursion_available": "k % 32 = 18", "response_code": "0", "query_count": "1", "answer_count": "CASE WHEN k % 32 = 17 THEN 0 ELSE 3 END", "query_name": "concat('n', k % 977, '.Test')", "query_type": "CASE WHEN k % 32 = 17 THEN 1 + k % 30 ELSE 1 END", "query_class": "1", "has_edns": "k % 32 = 18", "edns_udp_size": "CASE WHEN k % 32 = 18 THEN 1232 END"}),
    "dhcp": ((19,), 0, {"op": "1", "htype": "1", "hlen": "6", "hops": "k % 9", "xid": "k", "secs": "k % 600", "flags": "32768", "ciaddr": "0", "yiaddr": "167968768 + k % 65536", "siaddr": "0", "giaddr": "0", "chaddr": "'020000000001'", "message_type": "1 + k % 8", "server_id": "167772162", "lease_time": "k", "subnet_mask": "4294967040", "router": "167772161", "dns_servers": "'8.8.8.8'"}),
    "ntp": ((20,), 0, {"version": "4", "mode": "3", "leap_indicator": "0", "stratum": "2 + k % 10", "poll": "6", "precision": "-20", "root_delay": "CAST(k % 100 AS DOUBLE)", "root_dispersion": "CAST(0.5 AS DOUBLE)"}),
    "tls": ((21,), 0, {"record_type": "22", "record_version": "771", "handshake_type": "1", "handshake_version": "771", "sni": "concat('s', k % 977, '.test')", "alpn": "'h2'", "cipher_suite_count": "3", "session_id_length": "0", "ja3": "'771,4865-49199,0-10-11-16,29,0'", "ja3_hash": "md5('771,4865-49199,0-10-11-16,29,0')"}),
    "ssh": ((22,), 0, {"protocol_version": "'2.0'", "software_version": "concat('Build_', k % 100)", "comments": "'note'"}),
    "quic": ((23,), 0, {"header_form": "'Long'", "long_packet_type": "'Initial'", "version": "1", "version_name": "'QUIC v1'", "dcid_length": "8", "dcid": "printf('%016x', k)", "scid_length": "0", "token_length": "0", "packet_length": "16 + k % 40"}),
    "netlink": ((25,), 0, {"msg_len": "52", "msg_type": "16", "msg_flags": "3", "msg_seq": "k", "msg_pid": "77", "is_request": "true", "is_multipart": "true", "is_ack": "false", "is_echo": "false"}),
    "rtnetlink": ((25,), 0, {"msg_type": "16", "link_index": "1 + k % 50", "link_type": "1", "link_flags": "4163", "if_name": "concat('eth', k % 10)", "mtu": "1400 + k % 100"}),
}


def _carried(name: str, kinds: tuple[int, ...] | None = None, ports: dict[str, str] | None = None) -> tuple[tuple[int, ...], dict[str, str]]:
    own_kinds, _, own = DECODED[name]
    return kinds or own_kinds, _IP4 | (ports or {}) | own


def _to(port: int) -> dict[str, str]:
    return {"src_port": _PORT, "dst_port": str(port)}


_V6 = {"src_ip": _B, "dst_ip": "concat('20010DB8', repeat('0', 20), 'FFFF')", "hop_limit": "32 + k % 64"}
_OUTER6 = {"tunnel_src": _B, "tunnel_dst": _V6["dst_ip"], "tunnel_hop_limit": "32 + k % 64", "tunnel_traffic_class": "0"}
_UDP = {"checksum": "0", "src_port": _PORT, "dst_port": "7777", "udp_length": "8 + k % 40", "length": "42 + k % 40"}
_MLD = {"type": "130", "code": "0", "type_name": "'Multicast Listener Query'", "mld_max_response_delay": "k % 10000", "mld_multicast_address": "'FF020000000000000000000000010003'"}
_TUNNELS = {
    2: ("'mpls'", "16 + k % 1000"), 10: ("'gre'", "k"), 11: ("'vxlan'", "k % 16777216"), 12: ("'gtp'", "k"), 26: ("'ip4inip6'", "NULL"),
}


def _by_kind(what: dict[int, str]) -> str:
    return "CASE k % 32 " + " ".join(f"WHEN {n} THEN {v}" for n, v in what.items()) + " END"


#: view -> (kinds, columns in SQL over the key)
VIEWED: dict[str, tuple[tuple[int, ...], dict[str, str]]] = {
    "packets": ((3, 4, 5, 6, 7, 0, 17, 19, 20, 21), {
        "ip_version": _by_kind({0: "NULL", 4: "6"} | dict.fromkeys((3, 5, 6, 7, 17, 19, 20, 21), "4")), "ip_ttl": "CASE WHEN k % 32 <> 0 THEN 32 + k % 64 END", "src_ip_v4": "CASE WHEN k % 32 NOT IN (0, 4) THEN 167837696 + k % 65536 END", "src_ip_v6": f"CASE WHEN k % 32 = 4 THEN {_B} END",
        "ip_protocol": _by_kind({3: "253", 4: "59", 5: "6", 21: "6", 7: "1"} | dict.fromkeys((6, 17, 19, 20), "17")), "protocol": _by_kind({0: "'ARP'", 5: "'TCP'", 21: "'TCP'", 7: "'ICMP'"} | dict.fromkeys((6, 17, 19, 20), "'UDP'")),
        "src_port": _by_kind({19: "68", 20: "123"} | dict.fromkeys((5, 6, 17, 21), _PORT)), "dst_port": _by_kind({5: "8080", 6: "7777", 17: "53", 19: "67", 20: "123", 21: "443"}), "eth_type": _by_kind({0: "2054", 4: "34525"} | dict.fromkeys((3, 5, 6, 7, 17, 19, 20, 21), "2048")),
        "arp_operation": "CASE WHEN k % 32 = 0 THEN 1 + (k // 32) % 2 END", "tcp_seq": "CASE WHEN k % 32 IN (5, 21) THEN k END", "tcp_flags": _by_kind({5: "18", 21: "24"}), "icmp_type": "CASE WHEN k % 32 = 7 THEN 8 END",
        "dns_query_name": "CASE WHEN k % 32 = 17 THEN concat('n', k % 977, '.Test') END", "tls_sni": "CASE WHEN k % 32 = 21 THEN concat('s', k % 977, '.test') END", "dhcp_message_type": "CASE WHEN k % 32 = 19 THEN 1 + k % 8 END", "ntp_stratum": "CASE WHEN k % 32 = 20 THEN 2 + k % 10 END", "eth_src": "'020000000001'",
    }),
    "tcp_packets": ((5,), _IP4 | _MACS | DECODED["tcp"][2] | {"length": "74", "ttl": "32 + k % 64"}), "udp_packets": ((6,), _IP4 | _MACS | _UDP), "icmp_packets": _carried("icmp"),
    "icmpv6_packets": ((8,), _V6 | DECODED["icmpv6"][2]), "ndp_packets": ((8,), _V6 | DECODED["icmpv6"][2]), "mld_packets": ((9,), _V6 | _MLD), "arp_packets": ((0,), _MACS | DECODED["arp"][2]),
    "dns_packets": _carried("dns", (17,), _to(53) | {"transport": "'UDP'"}), "dhcp_packets": _carried("dhcp", ports={"src_port": "68", "dst_port": "67"}), "ntp_packets": _carried("ntp", ports={"src_port": "123", "dst_port": "123"}),
    "tls_packets": _carried("tls", ports=_to(443) | {"tcp_flags": "24"}), "ssh_packets": _carried("ssh", ports=_to(22)), "quic_packets": _carried("quic", ports=_to(443)), "bgp_packets": _carried("bgp", ports=_to(179)),
    "ospf_packets": ((16,), DECODED["ospf"][2] | {"src_ip": "167837696 + k % 65536", "dst_ip": "3232235521"}), "vxlan_packets": _carried("vxlan", ports=_to(4789)), "gtp_packets": _carried("gtp", ports=_to(2152)),
    "mpls_packets": ((2,), _MACS | DECODED["mpls"][2]), "ipsec_packets": ((13, 14), _IP4 | DECODED["ipsec"][2]), "gre_packets": ((10,), _IP4 | {"protocol": "2048", "key": "k", "key_present": "true", "version": "0"}),
    "tunneled_packets": (tuple(_TUNNELS), {
        "inner_src_ipv4": _INNER["src_ip"], "inner_dst_ipv4": _INNER["dst_ip"], "inner_proto_v4": "17", "inner_ttl": "17", "encap_depth": "1", "tunnel_type": _by_kind({n: t for n, (t, _) in _TUNNELS.items()}), "tunnel_id": _by_kind({n: i for n, (_, i) in _TUNNELS.items()}),
        "outer_src_ipv4": "CASE WHEN k % 32 IN (10, 11, 12) THEN 167837696 + k % 65536 END", "outer_src_ipv6": f"CASE WHEN k % 32 = 26 THEN {_B} END",
    }),
    "ip4_in_ip6": ((26,), _OUTER6 | _INNER | {"encap_depth": "1", "tunnel_type": "'ip4inip6'", "total_length": "30"}),
    "ip6_in_ip6": ((27,), _OUTER6 | {"src_ip": "'FD000000000000000000000000000001'", "dst_ip": "concat('FD00', repeat('0', 24), printf('%04X', k % 65536))", "next_header": "59", "hop_limit": "9", "payload_length": "0", "encap_depth": "1", "tunnel_type": "'ip6inip6'"}),
    "http_packets": ((28,), {"is_request": "true", "method": "'GET'", "uri": "concat('/o/', k)", "version": "'HTTP/1.1'", "host": "concat('h', k % 97, '.test')", "user_agent": "concat('u', k % 7)", "src_ip_v4": _IP4["src_ip_v4"], "src_port": _PORT, "dst_port": "80"}),
}


def _columns_of(view: str) -> list[str]:
    text = next(v.columns for v in VIEWS if v.name == view)
    return [re.search(r"(\w+)$", part).group(1) for part in re.split(r", (?![^(]*\))", text)]


for _name, (_kinds, _cols) in VIEWED.items():
    VIEWED[_name] = _kinds, {c: e for c, e in _cols.items() if c in set(_columns_of(_name))}


def _shown(df: DataFrame, columns: dict[str, str]) -> list:
    """The columns in forms that both engines share: bytes as hexadecimal text, whole numbers as long."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        v = F.col(c)
        if kinds[c] == "binary":
            v = F.hex(v)
        elif kinds[c] in ("tinyint", "smallint", "int", "bigint"):
            v = v.cast("long")
        out.append(v.alias(c))
    return out


def _key_of(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.expr(_KEY))


def _expected(kinds: tuple[int, ...], columns: dict[str, str], where: str = "true") -> str:
    def shared(e: str) -> str:
        return e if re.search(r"'|true|false|<>|= \d|DOUBLE|md5", e) and not re.search(r"THEN (?:\d|k)", e) else f"CAST({e} AS BIGINT)"

    return f"SELECT k, {', '.join(f'{shared(e)} AS {c}' for c, e in columns.items())} FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) WHERE k % {KINDS} IN ({', '.join(map(str, kinds))}) AND {where}"


def _decoded(name: str) -> Callable[[SparkSession, str], DataFrame]:
    kinds, _, _ = DECODED[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        # a packet depends on its key alone and a layer on its packet alone, so the condition on the kind goes before the writing
        return _decoded_rows(opened(spark, d, kinds), name)

    return query


def _decoded_rows(e: Engine, name: str) -> DataFrame:
    """The rows of a decoder's own kinds in an engine that may hold packets of any."""
    kinds, depth, columns = DECODED[name]
    rows = _key_of(e.table(name).where(F.col("encap_depth") == depth).join(e.table("frames").select("frame_number", "timestamp"), "frame_number"))
    rows = rows.where((F.col("k") % KINDS).isin(*kinds))
    return rows.select("k", *_shown(rows, columns))


def _viewed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    kinds, columns = VIEWED[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _key_of(opened(spark, d).table(name))
        rows = rows.where((F.col("k") % KINDS).isin(*kinds))
        if name == "http_packets":
            rows = rows.where("is_request")
        return rows.select("k", *_shown(rows, columns))

    return query


def _engine(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return opened(spark, d).sql(text)

    return query


def _tool(make: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return make(opened(spark, d).spark)

    return query


_KEYS = "WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)"
_FRAMES_OF = "CASE k % 32 WHEN 28 THEN 10 WHEN 29 THEN 8 WHEN 30 THEN 8 WHEN 31 THEN 5 ELSE 1 END"

#: query -> (Spark, SQL)
STREAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "stream_connections": (
        _engine("SELECT client_ip, client_port, server_ip, server_port, state, packets_to_server, packets_to_client, bytes_to_server, bytes_to_client, is_complete, duration_us FROM tcp_connections WHERE server_ip IN ('172.31.0.1', '172.31.0.3')"),
        f"""{_KEYS} SELECT {_A} AS client_ip, {_PORT} AS client_port, CASE WHEN k % 32 = 28 THEN '172.31.0.1' ELSE '172.31.0.3' END AS server_ip, CASE WHEN k % 32 = 28 THEN 80 ELSE 9000 END AS server_port, CASE WHEN k % 32 = 28 THEN 'time_wait' ELSE 'reset' END AS state,
            CASE WHEN k % 32 = 28 THEN 5 ELSE 6 END AS packets_to_server, CASE WHEN k % 32 = 28 THEN 5 ELSE 2 END AS packets_to_client,
            CASE WHEN k % 32 = 28 THEN 50 + length(concat(k)) + length(concat(k % 97)) ELSE 17 + 2 * (k % 30) END AS bytes_to_server, CASE WHEN k % 32 = 28 THEN 65 + length(concat(k % 50)) + k % 50 ELSE 0 END AS bytes_to_client,
            true AS is_complete, CASE WHEN k % 32 = 28 THEN 9 ELSE 7 END AS duration_us FROM o WHERE k % 32 IN (28, 30)""",
    ),
    "stream_payloads": (
        _engine("SELECT c.client_ip, c.client_port, hex(s.payload) AS payload, s.is_complete, s.gap_count, s.retransmit_count, s.out_of_order_count FROM tcp_streams s JOIN tcp_connections c USING (connection_id) WHERE c.server_ip = '172.31.0.3' AND s.direction = 'to_server'"),
        f"{_KEYS} SELECT {_A} AS client_ip, {_PORT} AS client_port, concat(repeat('61', 10), repeat('62', CAST(1 + k % 30 AS INTEGER)), repeat('63', 5)) AS payload, false AS is_complete, 0 AS gap_count, 1 AS retransmit_count, 1 AS out_of_order_count FROM o WHERE k % 32 = 30",
    ),
    "stream_idle_split": (
        _engine("SELECT client_ip, client_port, count(*) AS n, sum(bytes_to_server) AS bytes FROM tcp_connections WHERE server_ip = '172.31.0.4' GROUP BY ALL"),
        f"{_KEYS} SELECT {_A} AS client_ip, {_PORT} AS client_port, CAST(count(*) * 2 AS BIGINT) AS n, CAST(sum(1 + k % 9) AS BIGINT) AS bytes FROM o WHERE k % 32 = 31 GROUP BY ALL",
    ),
    "stream_http": (
        _engine("SELECT c.client_ip, c.client_port, m.is_request, m.method, m.uri, m.status_code, m.status_text, m.host, m.content_type, m.content_length FROM http_messages m JOIN tcp_connections c USING (connection_id)"),
        f"""{_KEYS} SELECT {_A} AS client_ip, {_PORT} AS client_port, r AS is_request, CASE WHEN r THEN 'GET' END AS method, CASE WHEN r THEN concat('/o/', k) END AS uri, CASE WHEN NOT r THEN 200 + (k // 32) % 3 END AS status_code, CASE WHEN NOT r THEN 'Fine' END AS status_text,
            CASE WHEN r THEN concat('h', k % 97, '.test') END AS host, CASE WHEN NOT r THEN 'text/plain' END AS content_type, CASE WHEN NOT r THEN k % 50 END AS content_length FROM o CROSS JOIN (VALUES (true), (false)) AS x(r) WHERE k % 32 = 28""",
    ),
    "stream_tls_sessions": (
        _engine("SELECT c.client_ip, c.client_port, t.version, t.cipher_suite, t.cipher_suite_id, t.sni, t.alpn, t.is_decrypted FROM tls_sessions t JOIN tcp_connections c USING (connection_id) WHERE c.server_ip = '172.31.0.2'"),
        f"{_KEYS} SELECT {_A} AS client_ip, {_PORT} AS client_port, 'TLS 1.2' AS version, 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256' AS cipher_suite, 49199 AS cipher_suite_id, concat('t', k % 97, '.test') AS sni, 'h2' AS alpn, true AS is_decrypted FROM o WHERE k % 32 = 29",
    ),
    "stream_http2": (
        _engine("SELECT c.client_ip, c.client_port, h.frame_type, h.stream_id, h.method, h.authority, h.status, h.data_length, h.end_stream FROM http2 h JOIN tcp_connections c USING (connection_id) WHERE h.frame_type <> 'SETTINGS'"),
        f"""{_KEYS} SELECT {_A} AS client_ip, {_PORT} AS client_port, f AS frame_type, 1 AS stream_id, CASE WHEN x = 1 THEN 'GET' END AS method, CASE WHEN x = 1 THEN 'www.example.com' END AS authority, CASE WHEN x = 2 THEN 200 END AS status, CASE WHEN x = 3 THEN 1 + k % 60 END AS data_length,
            x <> 2 AS end_stream FROM o CROSS JOIN (VALUES (1, 'HEADERS'), (2, 'HEADERS'), (3, 'DATA')) AS y(x, f) WHERE k % 32 = 29""",
    ),
    "tool_stats": (
        _tool(stats),
        f"""{_KEYS}, n AS (SELECT k % 32 AS kind, count(*) AS n FROM o GROUP BY ALL) SELECT protocol, CAST(coalesce(sum(n * times), 0) AS BIGINT) AS cnt FROM (VALUES ('tcp', 5, 1), ('tcp', 15, 1), ('tcp', 21, 1), ('tcp', 22, 1), ('tcp', 28, 10), ('tcp', 29, 8), ('tcp', 30, 8), ('tcp', 31, 5),
            ('udp', 1, 1), ('udp', 2, 1), ('udp', 6, 1), ('udp', 10, 1), ('udp', 11, 2), ('udp', 12, 2), ('udp', 14, 1), ('udp', 17, 1), ('udp', 18, 1), ('udp', 19, 1), ('udp', 20, 1), ('udp', 23, 1), ('udp', 24, 1), ('udp', 26, 1),
            ('icmp', 7, 1), ('dns', 17, 1), ('dns', 18, 1), ('http', 28, 2), ('tls', 21, 1), ('tls', 29, 5)) AS v(protocol, kind, times) LEFT JOIN n USING (kind) GROUP BY protocol""",
    ),
    "tool_time_info": (
        _tool(lambda s: time_info(s).selectExpr("unix_micros(CAST(start_time AS TIMESTAMP)) AS start_us", "unix_micros(CAST(end_time AS TIMESTAMP)) AS end_us", "frames")),
        f"{_KEYS} SELECT CAST({BASE_US} + 1000 * min(k) AS BIGINT) AS start_us, CAST(max({BASE_US} + 1000 * k + {_FRAMES_OF} - 1 + CASE WHEN k % 32 = 31 THEN {_IDLE_STEP} ELSE 0 END) AS BIGINT) AS end_us, CAST(sum({_FRAMES_OF}) AS BIGINT) AS frames FROM o",
    ),
    "tool_top": (
        _tool(lambda s: top(s, "query_type", 5)),
        f"{_KEYS} SELECT CASE WHEN k % 32 = 17 THEN CAST(1 + k % 30 AS INTEGER) ELSE 1 END AS query_type, count(*) AS count FROM o WHERE k % 32 IN (17, 18) GROUP BY ALL ORDER BY count DESC, query_type LIMIT 5",
    ),
    "tool_histogram": (
        _tool(lambda s: histogram(s, "yiaddr").select(F.col("bucket").cast("long").alias("bucket"), "count")),
        f"{_KEYS}, v AS (SELECT CAST(167968768 + k % 65536 AS DOUBLE) AS y FROM o WHERE k % 32 = 19), w AS (SELECT greatest((max(y) - min(y)) / 10, 1) AS width FROM v) SELECT CAST(floor(floor(y / width) * width) AS BIGINT) AS bucket, count(*) AS count FROM v, w GROUP BY ALL",
    ),
    "tool_filter_count": (
        lambda spark, d: opened(spark, d).sql("SELECT count(*) AS n, min(length) AS least FROM frames", filter="udp port 53 and not net 10.1.0.0/20"),
        f"{_KEYS} SELECT count(*) AS n, min(CASE WHEN k % 32 = 17 THEN 65 + length(concat('n', k % 977)) ELSE 163 END) AS least FROM o WHERE k % 32 IN (17, 18) AND k % 65536 >= 4096",
    ),
    "tool_filter_limit": (
        lambda spark, d: opened(spark, d).sql("SELECT src_port, dst_port FROM udp ORDER BY frame_number LIMIT 3", filter="udp port 67").distinct(),
        "SELECT 68 AS src_port, 67 AS dst_port",
    ),
}

#: Views that give a row for every combination of the layers of a tunnel: outer and inner addresses, and
#: ports where the carrier is UDP.
_COMBINED = {"gre_packets": 1, "vxlan_packets": 2, "gtp_packets": 2}


def _combined(view: str) -> str:
    kinds, columns = VIEWED[view]
    inner = {"src_ip_v4": _INNER["src_ip"], "dst_ip_v4": _INNER["dst_ip"]} | ({"dst_port": "9"} if _COMBINED[view] == 2 else {})
    address, port = "CASE WHEN a THEN CAST({} AS BIGINT) ELSE CAST({} AS BIGINT) END", "CASE WHEN b THEN CAST({} AS BIGINT) ELSE CAST({} AS BIGINT) END"
    cells = [(address if c.endswith("_v4") else port).format(inner[c], e) if c in inner else f"CAST({e} AS {'BOOLEAN' if e in ('true', 'false') else 'BIGINT'})" for c, e in columns.items()]
    second = "(VALUES (false), (true)) AS y(b)" if _COMBINED[view] == 2 else "(VALUES (false)) AS y(b)"
    return f"SELECT k, {', '.join(f'{e} AS {c}' for e, c in zip(cells, columns, strict=True))} FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) CROSS JOIN (VALUES (false), (true)) AS x(a) CROSS JOIN {second} WHERE k % {KINDS} = {kinds[0]}"


QUERIES = {f"decode_{n}": _decoded(n) for n in DECODED} | {f"view_{n}": _viewed(n) for n in VIEWED} | {n: q for n, (q, _) in STREAMS.items()}
ORACLES = {f"decode_{n}": _expected(kinds, columns) for n, (kinds, _, columns) in DECODED.items()} | {f"view_{n}": _expected(kinds, columns) for n, (kinds, columns) in VIEWED.items()} | {f"view_{n}": _combined(n) for n in _COMBINED} | {n: sql for n, (_, sql) in STREAMS.items()}
