"""Connections of captures and everything that their byte streams tell, in one pass.

TCP segments are decoded from the frames, partitioned by connection and sorted by frame; each task
streams through its connections and holds one at a time, whose bytes are bounded by ``limit`` per
direction. So a connection that holds a third of all segments costs one task its time, as the order of
its segments demands, but no more memory than any other; counting and grouping never gather a
connection's rows. An idle gap ends a connection.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake import schema
from wirelake.decode import core, tables, tls  # noqa: F401
from wirelake.session import cut
from wirelake.streaming import http1, http2, tls_crypto
from wirelake.streaming.tcp import IDLE_US, MOST_BYTES, TO_CLIENT, TO_SERVER, Connection, Segment, Stream

_SEGMENT = "conn string, frame_number bigint, ts bigint, forward boolean, a_ip string, a_port int, b_ip string, b_port int, seq bigint, flags int, payload binary"
#: kind of row -> (column, kind) of its struct; connection ids are given afterwards
KINDS = {**{n: schema.fields(n) for n in schema.STREAMS}, "http": [("frame_number", "u64"), *schema.own_fields("http")], "http2": [("connection_id", "i64"), ("frame_number", "u64"), *schema.own_fields("http2")]}


def segments(frames: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per TCP segment with its connection key, whatever lies below it: VLAN tags, both IP
    versions, tunnels. ``depth`` keeps segments of one encapsulation depth only."""
    extra = [F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conn", pa.string()), ("frame_number", pa.int64()), ("ts", pa.int64()), ("forward", pa.bool_()), ("a_ip", pa.string()), ("a_port", pa.int32()), ("b_ip", pa.string()), ("b_port", pa.int32()), ("seq", pa.int64()), ("flags", pa.int32()), ("payload", pa.binary())])
        for batch in batches:
            rows = []
            for number, link, data, us in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None or link is None:
                    continue
                ip: tuple[Any, Any] | None = None
                for name, d, kind, ident, f, rest in core.walk(data, link):
                    if name in ("ipv4", "ipv6"):
                        ip = (f.get("src_ip"), f.get("dst_ip")) if f else None
                    elif name == "tcp" and ip and "options_length" in f and (depth is None or d == depth):
                        src, dst = (str(ipaddress.ip_address(x)) for x in ip)
                        one, two = (src, f["src_port"]), (dst, f["dst_port"])
                        forward = one <= two
                        a, b = (one, two) if forward else (two, one)
                        rows.append((f"{a[0]}|{a[1]}|{b[0]}|{b[1]}|{kind or ''}|{'' if ident is None else ident}|{d}", number, us, forward, *a, *b, f["seq"], f["flags"], rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], schema=kinds)

    return frames.select("frame_number", "link_type", "raw_data", *extra).mapInArrow(decode, _SEGMENT)


class _TlsSide:
    """Reading position and keys of one direction of a TLS connection."""

    def __init__(self) -> None:
        self.keys: tls_crypto.Keys | None = None
        self.pending: tls_crypto.Keys | None = None
        self.plain = bytearray()
        self.marks: list[tuple[int, int]] = []


def _records(s: Stream) -> list[tuple[int, int, int, int, bytes]]:
    """(frame, end offset, type, version, body) of the TLS records of a stream."""
    out, at, data = [], 0, s.data
    while at + 5 <= len(data):
        size = int.from_bytes(data[at + 3 : at + 5], "big")
        if not 20 <= data[at] <= 24 or data[at + 1] != 3 or at + 5 + size > len(data):
            break
        end = at + 5 + size
        out.append((s.frame_of(end), end, data[at], int.from_bytes(data[at + 1 : at + 3], "big"), bytes(data[at + 5 : end])))
        at = end
    return out


def tls_session(c: Connection, secrets: dict[bytes, dict[str, bytes]]) -> tuple[dict[str, Any] | None, tuple[Stream, Stream] | None]:
    """The session of a connection and, where the key log holds its secrets, the decrypted streams."""
    found = [_records(s) for s in c.streams]
    if not found[0] and not found[1]:
        return None, None
    hello: list[dict[str, Any]] = [{}, {}]
    for side in (0, 1):
        for _, _, kind, _, body in found[side]:
            if kind == 22 and len(body) > 4 and body[0] == side + 1:
                try:
                    hello[side] = (tls.client_hello if side == 0 else tls.server_hello)(body[4 : 4 + int.from_bytes(body[1:4], "big")])
                except (core.Short, IndexError):
                    pass
                break
    client, server = hello
    if not client and not server:
        return None, None
    tls13 = "TLS 1.3" in (server.get("supported_versions") or "")
    suite = server.get("selected_cipher_id")
    row = {
        "version": "TLS 1.3" if tls13 else server.get("version") or client.get("version"), "cipher_suite": server.get("selected_cipher"), "cipher_suite_id": suite, "sni": client.get("sni"),
        "alpn": server.get("alpn") or client.get("alpn"), "is_decrypted": False, "first_frame": min(r[0][0] for r in found if r),
    }
    known = secrets.get(client.get("client_random", b""), {})
    if not known or suite is None:
        return row, None
    sides = (_TlsSide(), _TlsSide())
    if tls13:
        for side, who in zip(sides, ("CLIENT", "SERVER"), strict=True):
            for slot, label in (("keys", f"{who}_HANDSHAKE_TRAFFIC_SECRET"), ("pending", f"{who}_TRAFFIC_SECRET_0")):
                if label in known:
                    setattr(side, slot, tls_crypto.keys13(suite, known[label]))
    elif "CLIENT_RANDOM" in known and (both := tls_crypto.keys12(suite, known["CLIENT_RANDOM"], client["client_random"], server["server_random"])):
        sides[0].pending, sides[1].pending = both
    for side, own in zip(sides, found, strict=True):
        _decrypt(side, own, tls13)
    if not any(s.plain for s in sides):
        return row, None
    row["is_decrypted"] = True
    out = []
    for s in sides:
        stream = Stream()
        stream.data, stream.marks = s.plain, s.marks
        out.append(stream)
    # an encrypted server may name the protocol only under its handshake keys
    return row, (out[0], out[1])


def _decrypt(side: _TlsSide, found: list[tuple[int, int, int, int, bytes]], tls13: bool) -> None:
    for frame, _, kind, version, body in found:
        if not tls13 and kind == 20:
            side.keys, side.pending = side.pending, None
            continue
        if side.keys is None or (tls13 and kind != 23):
            continue
        plain = side.keys.open(kind, version, body)
        if plain is None and tls13 and side.pending is not None:
            # the log may lack the handshake keys, or they are over
            plain = side.pending.open(kind, version, body)
            if plain is not None:
                side.keys, side.pending = side.pending, None
        if plain is None:
            continue
        if tls13:
            plain = plain.rstrip(b"\0")
            kind, plain = plain[-1] if plain else 0, plain[:-1]
            if kind == 22 and plain[:1] == b"\x14" and side.pending is not None:
                side.keys, side.pending = side.pending, None  # Finished: the traffic keys begin
        if kind == 23 and plain:
            side.plain += plain
            side.marks.append((len(side.plain), frame))


def facts(c: Connection, secrets: dict[bytes, dict[str, bytes]]) -> list[tuple[str, dict[str, Any]]]:
    """(kind of row, fields) of one connection."""
    out: list[tuple[str, dict[str, Any]]] = [("tcp_connections", c.row())]
    out += [("tcp_streams", r) for r in c.stream_rows()]
    streams: tuple[Stream, Stream] | None = c.streams
    if bytes(c.streams[0].data[:1]) in (b"\x16",) or bytes(c.streams[1].data[:1]) in (b"\x16",):
        session, streams = tls_session(c, secrets)
        if session:
            out.append(("tls_sessions", session))
    if streams is None:
        return out
    if bytes(streams[0].data).startswith(http2.PREFACE):
        h2 = http2.Http2()
        frames = []
        for side, s in enumerate(streams):
            # headers of a side depend on that side alone; the order over both is that of the frames
            frames += [(s.frame_of(end), side, f) for end, f in h2.frames(bytes(s.data), side)]
        frames.sort(key=lambda x: x[0] or 0)
        out += [("http2", {"frame_number": n, **f}) for n, _, f in frames]
    elif any(http1.is_http(bytes(s.data[:16])) for s in streams):
        found = [(s.frame_of(m.end), k, m) for k, s in enumerate(streams) for m in http1.messages(bytes(s.data), s.finished or c.state in ("reset", "closed", "time_wait"))]
        for i, (n, k, m) in enumerate(sorted(found, key=lambda x: (x[0] or 0, x[1]))):
            f = m.fields
            row = {"message_id": i + 1, "direction": (TO_SERVER, TO_CLIENT)[k], "first_frame": n, "http_version": f.get("version")}
            out.append(("http_messages", row | {x: f.get(x) for x in ("is_request", "method", "uri", "status_code", "status_text", "host", "content_type", "content_length", "user_agent", "server")}))
            out.append(("http", {"frame_number": n, **f}))
    return out


def analysed(frames: DataFrame, key_log: str = "", idle_us: int = IDLE_US, limit: int = MOST_BYTES) -> DataFrame:
    """Rows of all stream tables: ``kind string, first bigint`` and a struct column per kind of row.

    ``first`` is the first frame of the connection, which no other connection shares. Segments
    without time never end a connection by idleness. An empty input gives an empty result.
    """
    secrets = tls_crypto.key_log(key_log)
    arrow = {n: pa.struct([pa.field(c, schema._KINDS[k][1]) for c, k in cols]) for n, cols in KINDS.items()}
    spark_type = T.StructType([T.StructField("kind", T.StringType()), T.StructField("first", T.LongType()), *[T.StructField(n, T.StructType([T.StructField(c, schema._KINDS[k][0]) for c, k in cols])) for n, cols in KINDS.items()]])

    def rows(done: list[tuple[int, str, dict[str, Any]]]) -> pa.RecordBatch:
        columns = []
        for n, cols in KINDS.items():
            columns.append(pa.array([{c: f.get(c) for c, _ in cols} if kind == n else None for _, kind, f in done], arrow[n]))
        return pa.RecordBatch.from_arrays([pa.array([k for _, k, _ in done], pa.string()), pa.array([n for n, _, _ in done], pa.int64()), *columns], ["kind", "first", *KINDS])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        c: Connection | None = None
        done: list[tuple[int, str, dict[str, Any]]] = []
        for batch in batches:
            for conn, number, ts, forward, a_ip, a_port, b_ip, b_port, seq, flags, payload in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                idle = c is not None and c.last is not None and ts is not None and ts - c.last > idle_us
                if conn != at or idle:
                    if c is not None:
                        done += [(c.first_frame, k, f) for k, f in facts(c, secrets)]
                    at, c = conn, Connection((a_ip, a_port), (b_ip, b_port), streams=(Stream(limit), Stream(limit)))
                    if len(done) >= 500:
                        yield rows(done)
                        done = []
                c.add(Segment(number, ts, forward, seq, flags, payload or b""))
        if c is not None:
            done += [(c.first_frame, k, f) for k, f in facts(c, secrets)]
        if done:
            yield rows(done)

    ordered = segments(frames).repartition("conn").sortWithinPartitions("conn", "frame_number")
    return ordered.mapInArrow(follow, spark_type)


def numbered(found: DataFrame) -> DataFrame:
    """``first bigint, connection_id bigint``: connections counted from 1 in the order of their first
    frames. Ranges of frames are counted apart and shifted by what lies before them."""
    firsts = cut(found.where("kind = 'tcp_connections'").select("first").repartitionByRange("first").sortWithinPartitions("first").withColumn("part", F.spark_partition_id()))
    # one number per partition
    sizes = {r["part"]: r["n"] for r in firsts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = firsts.sparkSession.createDataFrame(before, "part int, before bigint")
    by = Window.partitionBy("part").orderBy("first")
    return firsts.withColumn("n", F.row_number().over(by)).join(F.broadcast(starts), "part").select("first", (F.col("n") + F.col("before")).alias("connection_id"))


def stream_table(found: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """One of the stream tables, or ``http`` and ``http2``, out of :func:`analysed`."""
    cols = [c for c, _ in KINDS[name]]
    own = found.where(F.col("kind") == name).select("first", f"{name}.*")
    if name in schema.STREAMS:
        return own.drop("connection_id").join(ids, "first").select(*cols)
    # a table like those of packets; http2 also tells the connection
    encap = [F.lit(0).cast("short").alias("encap_depth"), F.lit(None).cast("string").alias("tunnel_type"), F.lit(None).cast("bigint").alias("tunnel_id")]
    if name == "http2":
        return own.drop("connection_id").join(ids, "first").select(*[c for c in cols if c != "connection_id"], *encap, "connection_id")
    return own.select(*cols, *encap)
