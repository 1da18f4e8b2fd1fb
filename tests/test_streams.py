from __future__ import annotations

import random
import struct

import packets as P
import pytest

from wirelake.engine import Engine
from wirelake.streaming import analysis, hpack, http1, http2, tcp, tls_crypto

GET = b"GET /a HTTP/1.1\r\nHost: h.test\r\nAuthorization: Basic abc\r\n\r\n"
OK = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\nhello"


def opened(spark, tmp_path, frames, key_log="", **kw):
    (tmp_path / "s.pcap").write_bytes(P.pcap(frames, **kw))
    return Engine.open(spark, str(tmp_path / "s.pcap"), key_log)


def test_connection_and_http(spark, tmp_path):
    t = P.Talk().open().send(0, GET, 24).send(1, OK, 24).close()
    e = opened(spark, tmp_path, t.frames)
    c = e.table("tcp_connections").first()
    assert (c.connection_id, c.client_port, c.server_port, c.state, c.packets_to_server, c.packets_to_client, c.bytes_to_server, c.bytes_to_client, c.is_complete) == (1, 40000, 80, "time_wait", 5, 4, len(GET), len(OK), True)
    m = e.table("http_messages").orderBy("message_id").collect()
    assert [(x.is_request, x.method, x.status_code, x.first_frame) for x in m] == [(True, "GET", None, 4), (False, None, 200, 5)]
    h = {r.is_request: r for r in e.table("http").collect()}
    assert h[True].authorization == "Basic" and h[False].set_cookie == "a=1" and h[False].body_length == 5 and h[True].encap_depth == 0
    s = {r.direction: bytes(r.payload) for r in e.table("tcp_streams").collect()}
    assert s == {"to_server": GET, "to_client": OK}
    assert e.sql("SELECT http_host FROM packets WHERE http_host IS NOT NULL").first()[0] == "h.test"


def test_shuffled_doubled_and_overlapping_segments():
    data = bytes(random.Random(1).randbytes(5000))
    for seed in range(20):
        rnd = random.Random(seed)
        start = rnd.choice([1, 0xFFFFFF00])
        pieces, at = [], 0
        while at < len(data):
            n = rnd.randint(1, 700)
            pieces.append((at, data[at : at + n]))
            at += max(1, n - rnd.choice([0, 0, 40]))
        pieces += rnd.sample(pieces, 5)
        rnd.shuffle(pieces)
        s = tcp.Stream()
        s.add(start - 1, tcp.SYN, b"", 1)
        for i, (a, b) in enumerate(pieces):
            s.add((start + a) & 0xFFFFFFFF, tcp.ACK, b, i + 2)
        assert bytes(s.data) == data and s.retransmits >= 1 and s.reordered >= 1 and s.gaps == 0
        assert s.frame_of(len(data)) == s.marks[-1][1]


def test_late_first_piece_gap_and_limit():
    s = tcp.Stream()
    s.add(200, tcp.ACK, b"world", 1)
    s.add(195, tcp.ACK, b"hello", 2)
    assert bytes(s.data) == b"helloworld"
    s.add(300, tcp.ACK, b"x", 3)
    assert s.gaps == 1 and not s.complete
    s = tcp.Stream(limit=4)
    s.add(1, tcp.ACK, b"abcdef", 1)
    assert bytes(s.data) == b"abcd" and s.cut


def test_states(spark, tmp_path):
    assert tcp.next_state("established", tcp.RST, True) == "reset"
    frames = P.Talk(("10.0.0.9", 50000), ("10.0.0.8", 443)).send(1, b"x", 24).send(0, b"", 16).frames
    other = P.Talk(("10.0.0.7", 1), ("10.0.0.6", 2)).open().send(0, b"a", 24).send(1, flags=4).frames
    rows = opened(spark, tmp_path, frames + other).table("tcp_connections").orderBy("connection_id").collect()
    assert [(r.connection_id, r.client_port, r.state) for r in rows] == [(1, 50000, "established"), (2, 1, "reset")]


def test_idle_gap_splits(spark, tmp_path):
    t = P.Talk().open().send(0, b"a", 24).send(0, b"b", 24)
    base = 1_700_000_000_000_000
    e = opened(spark, tmp_path, t.frames, times=[base, base + 1, base + 2, base + 3, base + 3 + 300_000_001])
    assert [r.first_frame for r in e.table("tcp_connections").orderBy("connection_id").collect()] == [1, 5]


def test_http_bodies():
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nwiki\r\n5;x=1\r\npedia\r\n0\r\nTrailer: a\r\n\r\n"
    m = http1.messages(chunked + OK)
    assert [x.fields["body_length"] for x in m] == [9, 5] and all(x.complete for x in m)
    assert not http1.messages(OK[:-2])[0].complete and http1.messages(b"\x16\3\1") == []
    assert [x.fields["status_code"] for x in http1.messages(b"HTTP/1.1 304 Not Modified\r\nContent-Length: 99\r\n\r\n" + OK)] == [304, 200]
    assert http1.messages(b"HTTP/1.1 200 OK\r\n\r\nrest", closed=True)[0].fields["body_length"] == 4


def test_hpack_vectors():
    # RFC 7541, C.4 and C.6
    d = hpack.Decoder()
    assert d.decode(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff"))[-1] == (":authority", "www.example.com")
    assert d.decode(bytes.fromhex("828684be5886a8eb10649cbf"))[-1] == ("cache-control", "no-cache")
    d = hpack.Decoder(256)
    first = d.decode(bytes.fromhex("488264025885aec3771a4b6196d07abe941054d444a8200595040b8166e082a62d1bff6e919d29ad171863c78f0b97c8e9ae82ae43d3"))
    assert first == [(":status", "302"), ("cache-control", "private"), ("date", "Mon, 21 Oct 2013 20:13:21 GMT"), ("location", "https://www.example.com")]
    assert d.decode(bytes.fromhex("4883640effc1c0bf"))[0] == (":status", "307") and d.used == 222
    for bad in (b"\xff\xff\xff\xff\xff\xff\xff", b"\x40", b"\xbf", b"\x00\x85\xff\xff\xff\xff\xff"):
        with pytest.raises(hpack.HpackError):
            hpack.Decoder().decode(bad)


def frame(kind: int, flags: int, stream: int, body: bytes = b"") -> bytes:
    return len(body).to_bytes(3, "big") + bytes([kind, flags]) + stream.to_bytes(4, "big") + body


REQUEST = bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")
CLIENT = http2.PREFACE + frame(4, 0, 0, struct.pack(">HI", 3, 100)) + frame(1, 0x01, 1, REQUEST[:5]) + frame(9, 4, 1, REQUEST[5:]) + frame(8, 0, 0, struct.pack(">I", 10)) + frame(6, 0, 0, bytes(8))
SERVER = frame(4, 1, 0) + frame(1, 4, 1, b"\x88") + frame(0, 9, 1, b"\2ab\0\0") + frame(3, 0, 3, struct.pack(">I", 8)) + frame(5, 4, 1, struct.pack(">I", 2) + b"\x82") + frame(7, 0, 0, struct.pack(">II", 1, 0) + b"bye") + frame(2, 0, 5, struct.pack(">IB", 0x80000003, 15))


def test_http2_frames():
    h = http2.Http2()
    c = [f for _, f in h.frames(CLIENT, 0)]
    s = [f for _, f in h.frames(SERVER, 1)]
    assert [f["frame_type"] for f in c] == ["SETTINGS", "HEADERS", "CONTINUATION", "WINDOW_UPDATE", "PING"] and c[0]["max_concurrent_streams"] == 100 and c[2]["authority"] == "www.example.com" and c[2]["stream_state"] == "half-closed (local)"
    assert [f["frame_type"] for f in s] == ["SETTINGS", "HEADERS", "DATA", "RST_STREAM", "PUSH_PROMISE", "GOAWAY", "PRIORITY"]
    assert s[1]["status"] == 200 and (s[2]["data_length"], s[2]["padding_length"], s[2]["stream_state"]) == (2, 2, "closed") and s[3]["error_name"] == "CANCEL" and s[5]["debug_data"] == "bye" and s[6]["priority_dependency"] == 3


def test_ciphers():
    k, n, a = bytes(range(32)), bytes(12), b"head"
    for f, key in ((tls_crypto.gcm, k[:16]), (tls_crypto.gcm, k), (tls_crypto.chacha, k)):
        text, tag = f(key, n, b"secret" * 20, a, None)
        assert f(key, n, text, a, tag)[0] == b"secret" * 20 and f(key, n, text, a, bytes(16)) is None
    # RFC 8439, 2.8.2 and the GCM specification, test case 4
    pt = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    assert tls_crypto.chacha(bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), pt, bytes.fromhex("50515253c0c1c2c3c4c5c6c7"), None)[1].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    # RFC 8448, 3: keys of the server's handshake
    secret = bytes.fromhex("b67b7d690cc16c4e75e54213cb2d37b4e9c912bcded9105d42befd59d391ad38")
    keys = tls_crypto.keys13(0x1301, secret)
    assert keys.key.hex() == "3fce516009c21727d0f2e4e86ee403bc" and keys.iv.hex() == "5d313eb2671276ee13000b30"


def sealed(keys: tls_crypto.Keys, kind: int, plain: bytes) -> bytes:
    """A record as the other side would send it."""
    f = tls_crypto.gcm if keys.cipher == "gcm" else tls_crypto.chacha
    if keys.tls13:
        plain += bytes([kind])
        nonce = (int.from_bytes(keys.iv, "big") ^ keys.seq).to_bytes(12, "big")
        text, tag = f(keys.key, nonce, plain, b"\x17\3\3" + (len(plain) + 16).to_bytes(2, "big"), None)
        body, kind = text + tag, 23
    else:
        explicit = keys.seq.to_bytes(8, "big") if keys.cipher == "gcm" else b""
        nonce = keys.iv + explicit if explicit else (int.from_bytes(keys.iv, "big") ^ keys.seq).to_bytes(12, "big")
        text, tag = f(keys.key, nonce, plain, keys.seq.to_bytes(8, "big") + bytes([kind]) + b"\3\3" + len(plain).to_bytes(2, "big"), None)
        body = explicit + text + tag
    keys.seq += 1
    return P.record(kind, body)


@pytest.mark.parametrize("suite", [0xC02F, 0xC030, 0xCCA8, 0x1301, 0x1302, 0x1303])
def test_decryption_up_to_http2(spark, tmp_path, suite):
    cr, sr = bytes(range(32)), bytes(range(32, 64))
    new = suite >> 8 == 0x13
    if new:
        secrets = {x: bytes([i]) * 48 for i, x in enumerate(("CLIENT_HANDSHAKE_TRAFFIC_SECRET", "SERVER_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0"))}
        log = "".join(f"{k} {cr.hex()} {v.hex()}\n" for k, v in secrets.items())
        hand = [tls_crypto.keys13(suite, secrets[f"{w}_HANDSHAKE_TRAFFIC_SECRET"]) for w in ("CLIENT", "SERVER")]
        app = [tls_crypto.keys13(suite, secrets[f"{w}_TRAFFIC_SECRET_0"]) for w in ("CLIENT", "SERVER")]
        fin = [sealed(k, 22, b"\x14\0\0\x04abcd") for k in hand]
    else:
        master = bytes(48)
        log = f"# comment\nCLIENT_RANDOM {cr.hex()} {master.hex()}\nnonsense\n"
        app = list(tls_crypto.keys12(suite, master, cr, sr))
        fin = [P.record(20, b"\1") + sealed(k, 22, b"\x14\0\0\x0cabcdabcdabcd") for k in app]
    t = P.Talk(server=("10.0.0.2", 443)).open().send(0, P.record(22, P.client_hello(cr)), 24).send(1, P.record(22, P.server_hello(sr, suite, new)) + fin[1], 24).send(0, fin[0], 24)
    t.send(0, sealed(app[0], 23, CLIENT[:40]) + sealed(app[0], 23, CLIENT[40:]), 24).send(1, sealed(app[1], 23, SERVER), 24)
    e = opened(spark, tmp_path, t.frames, log)
    s = e.table("tls_sessions").first()
    assert s.is_decrypted and s.sni == "www.test" and s.cipher_suite_id == suite and s.version == ("TLS 1.3" if new else "TLS 1.2")
    rows = e.table("http2").orderBy("frame_number").collect()
    assert len(rows) == 12 and {r.connection_id for r in rows} == {1} and [r.authority for r in rows if r.authority] == ["www.example.com"] and {r.frame_number for r in rows} == {7, 8}
    assert not opened(spark, tmp_path, t.frames).table("tls_sessions").first().is_decrypted


def test_analysis_of_nothing(spark):
    empty = spark.createDataFrame([], "frame_number bigint, timestamp timestamp_ntz, link_type int, raw_data binary")
    assert analysis.analysed(empty).count() == 0
