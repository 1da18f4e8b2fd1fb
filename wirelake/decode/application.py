"""Application protocols over TCP and UDP except TLS: DNS, DHCP, NTP, SSH, QUIC, BGP."""

from __future__ import annotations

import re
from typing import Any

from wirelake.decode.core import PORTS, Hints, Layer, Short, decoder, need, quad, u16, u32
from wirelake.functions.names import BGP_MESSAGE, BGP_ORIGIN

# fixed values
_SSH_MESSAGE = {
    1: "DISCONNECT", 2: "IGNORE", 3: "UNIMPLEMENTED", 4: "DEBUG", 5: "SERVICE_REQUEST", 6: "SERVICE_ACCEPT", 20: "KEXINIT", 21: "NEWKEYS", 30: "KEX_DH_INIT", 31: "KEX_DH_REPLY", 50: "USERAUTH_REQUEST",
    51: "USERAUTH_FAILURE", 52: "USERAUTH_SUCCESS", 53: "USERAUTH_BANNER", 90: "CHANNEL_OPEN", 91: "CHANNEL_OPEN_CONFIRMATION", 92: "CHANNEL_OPEN_FAILURE", 93: "CHANNEL_WINDOW_ADJUST", 94: "CHANNEL_DATA",
    95: "CHANNEL_EXTENDED_DATA", 96: "CHANNEL_EOF", 97: "CHANNEL_CLOSE", 98: "CHANNEL_REQUEST", 99: "CHANNEL_SUCCESS", 100: "CHANNEL_FAILURE",
}
_BGP_CAPABILITY = {1: "Multiprotocol", 2: "Route Refresh", 3: "ORF", 5: "Extended Next Hop", 6: "Extended Message", 64: "Graceful Restart", 65: "4-byte AS", 69: "ADD-PATH", 70: "Enhanced Route Refresh"}
_BGP_ERROR = {
    1: "Message Header Error", 2: "OPEN Message Error", 3: "UPDATE Message Error", 4: "Hold Timer Expired", 5: "Finite State Machine Error", 6: "Cease", 7: "ROUTE-REFRESH Message Error",
}
_QUIC_VERSION = {0: "Version Negotiation", 1: "QUIC v1", 0x6B3343CF: "QUIC v2"}
_QUIC_PACKET = ("Initial", "0-RTT", "Handshake", "Retry")


def on(*ports: int):
    """Either port is one of these."""
    PORTS.update(ports)
    return lambda h: h.transport is not None and (h.src_port in ports or h.dst_port in ports)


def _name(b: bytes, at: int) -> tuple[str, int]:
    """A domain name and the place after it; pointers are followed, each only backwards."""
    labels, after, limit = [], None, at
    while True:
        size = b[at]
        if size & 0xC0 == 0xC0:
            target = ((size & 0x3F) << 8) | b[at + 1]
            after = at + 2 if after is None else after
            if target >= limit:
                raise ValueError("forward pointer")
            at = limit = target
        elif size == 0:
            return ".".join(labels), at + 1 if after is None else after
        else:
            if size & 0xC0 or at + 1 + size > len(b):
                raise ValueError("bad label")
            labels.append(b[at + 1 : at + 1 + size].decode("utf-8", "replace"))
            at += 1 + size


@decoder("dns", on(53), about="Domain names")
def dns(b: bytes, h: Hints) -> Layer:
    if h.transport == "tcp":
        # messages over TCP begin with their length
        need(b, 2)
        size = u16(b, 0)
        b = b[2 : 2 + size] if size <= len(b) - 2 else b[2:]
    need(b, 12)
    flags = u16(b, 2)
    out: dict[str, Any] = {
        "transaction_id": u16(b, 0), "is_query": not flags & 0x8000, "opcode": (flags >> 11) & 15, "is_authoritative": bool(flags & 0x400), "is_truncated": bool(flags & 0x200),
        "recursion_desired": bool(flags & 0x100), "recursion_available": bool(flags & 0x80), "response_code": flags & 15, "query_count": u16(b, 4), "answer_count": u16(b, 6), "authority_count": u16(b, 8),
        "additional_count": u16(b, 10),
    }
    try:
        at = 12
        for i in range(out["query_count"]):
            name, at = _name(b, at)
            need(b, at + 4)
            if i == 0:
                out |= {"query_name": name, "query_type": u16(b, at), "query_class": u16(b, at + 2)}
            at += 4
        lists: dict[str, list] = {"answer_ip4s": [], "answer_ip6s": [], "answer_cnames": [], "answer_types": [], "answer_ttls": []}
        edns, size = False, None
        for i in range(out["answer_count"] + out["authority_count"] + out["additional_count"]):
            _, at = _name(b, at)
            need(b, at + 10)
            kind, klass, ttl, length = u16(b, at), u16(b, at + 2), u32(b, at + 4), u16(b, at + 8)
            at += 10
            need(b, at + length)
            if i < out["answer_count"]:
                lists["answer_types"].append(kind)
                lists["answer_ttls"].append(ttl)
                if kind == 1 and length == 4:
                    lists["answer_ip4s"].append(u32(b, at))
                elif kind == 28 and length == 16:
                    lists["answer_ip6s"].append(b[at : at + 16])
                elif kind == 5:
                    lists["answer_cnames"].append(_name(b, at)[0])
            elif kind == 41:
                edns, size = True, klass
            at += length
        out |= lists | {"has_edns": edns, "edns_udp_size": size}
    except (Short, IndexError, ValueError):
        raise Short(out) from None
    return out, b"", None


@decoder("dhcp", on(67, 68), about="Host configuration")
def dhcp(b: bytes, h: Hints) -> Layer:
    need(b, 236)
    out: dict[str, Any] = {
        "op": b[0], "htype": b[1], "hlen": b[2], "hops": b[3], "xid": u32(b, 4), "secs": u16(b, 8), "flags": u16(b, 10), "ciaddr": u32(b, 12), "yiaddr": u32(b, 16), "siaddr": u32(b, 20), "giaddr": u32(b, 24),
        "chaddr": b[28:34],
    }
    at = 240 if b[236:240] == b"\x63\x82\x53\x63" else len(b)
    while at < len(b) and b[at] != 255:
        if b[at] == 0:
            at += 1
            continue
        if at + 1 >= len(b) or at + 2 + b[at + 1] > len(b):
            break
        code, v = b[at], b[at + 2 : at + 2 + b[at + 1]]
        at += 2 + len(v)
        if code == 53 and v:
            out["message_type"] = v[0]
        elif code == 6:
            out["dns_servers"] = ",".join(quad(v, i) for i in range(0, len(v) - 3, 4))
        elif len(v) >= 4 and (name := {1: "subnet_mask", 3: "router", 51: "lease_time", 54: "server_id"}.get(code)):
            out[name] = u32(v, 0)
    return out, b"", None


def _fixed(v: int, bits: int = 16) -> float:
    return v / (1 << bits)


@decoder("ntp", on(123), about="Network time")
def ntp(b: bytes, h: Hints) -> Layer:
    need(b, 48)
    stratum = b[1]
    ref = b[12:16].rstrip(b"\0").decode("ascii", "replace") if stratum <= 1 else quad(b, 12)
    out = {
        "version": (b[0] >> 3) & 7, "mode": b[0] & 7, "leap_indicator": b[0] >> 6, "stratum": stratum, "poll": int.from_bytes(b[2:3], "big", signed=True), "precision": int.from_bytes(b[3:4], "big", signed=True),
        "root_delay": _fixed(u32(b, 4)), "root_dispersion": _fixed(u32(b, 8)), "reference_id": ref, "reference_ts": float(u32(b, 16)), "origin_ts": float(u32(b, 24)), "receive_ts": float(u32(b, 32)),
        "transmit_ts": float(u32(b, 40)),
    }
    return out, b"", None


@decoder("ssh", on(22), priority=50, about="Secure shell")
def ssh(b: bytes, h: Hints) -> Layer:
    if b.startswith(b"SSH-"):
        line = b.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace")
        _, version, rest = (line.split("-", 2) + ["", ""])[:3]
        software, _, comments = rest.partition(" ")
        return {"protocol_version": version, "software_version": software, "comments": comments or None, "encrypted": False}, b"", None
    need(b, 6)
    size = u32(b, 0)
    if not 2 <= size <= 35000 or size + 4 > len(b) + 35000 or b[4] >= size:
        return {"encrypted": True}, b"", None
    kind = b[5]
    out: dict[str, Any] = {"packet_length": size, "padding_length": b[4], "msg_type": kind, "msg_type_name": _SSH_MESSAGE.get(kind, f"UNKNOWN({kind})"), "encrypted": False}
    body = b[6 : 4 + size - b[4]]
    texts = _ssh_strings(body[16:] if kind == 20 else body)
    if kind == 20:
        # name lists: key exchange, host key, then encryption, authentication and compression of the client's direction
        for i, name in ((0, "kex_algorithms"), (1, "host_key_algorithms"), (2, "encryption_algorithms"), (4, "mac_algorithms"), (6, "compression_algorithms")):
            if i < len(texts):
                out[name] = texts[i]
    elif kind == 50:
        out |= dict(zip(("auth_username", "auth_service", "auth_method"), texts, strict=False))
    elif kind == 90 and texts:
        out["channel_type"] = texts[0]
        at = 4 + u32(body, 0)
        if at + 4 <= len(body):
            out["channel_id"] = u32(body, at)
    return out, b"", None


def _ssh_strings(b: bytes) -> list[str]:
    out, at = [], 0
    while at + 4 <= len(b) and at + 4 + (n := u32(b, at)) <= len(b):
        out.append(b[at + 4 : at + 4 + n].decode("utf-8", "replace"))
        at += 4 + n
    return out


def _varint(b: bytes, at: int) -> tuple[int, int]:
    size = 1 << (b[at] >> 6)
    need(b, at + size)
    return int.from_bytes(b[at : at + size], "big") & ((1 << (8 * size - 2)) - 1), at + size


_HOST = re.compile(rb"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+")


@decoder("quic", lambda h: h.transport == "udp" and (h.src_port in (443, 8443) or h.dst_port in (443, 8443)), priority=40, about="QUIC")
def quic(b: bytes, h: Hints) -> Layer:
    if not b[0] & 0x80:
        # a short header does not say how long its connection id is; eight bytes are usual
        return {"header_form": "Short", "spin_bit": bool(b[0] & 0x20), "key_phase": bool(b[0] & 4), "dcid": b[1:9].hex(), "dcid_length": len(b[1:9])}, b"", None
    need(b, 7)
    version = u32(b, 1)
    name = _QUIC_VERSION.get(version) or (f"Draft-{version & 0xFF}" if version >> 8 == 0xFF0000 else f"0x{version:08x}")
    out: dict[str, Any] = {"header_form": "Long", "version": version, "version_name": name}
    n = b[5]
    need(b, 7 + n, out)
    m = b[6 + n]
    need(b, 7 + n + m, out)
    out |= {"dcid_length": n, "dcid": b[6 : 6 + n].hex(), "scid_length": m, "scid": b[7 + n : 7 + n + m].hex()}
    if version == 0:
        return out, b"", None
    # version 2 turns the packet types by one
    kind = ((b[0] >> 4) & 3) if version != 0x6B3343CF else (((b[0] >> 4) & 3) - 1) % 4
    out["long_packet_type"] = _QUIC_PACKET[kind]
    at = 7 + n + m
    if kind == 0:
        token, at = _varint(b, at)
        out["token_length"] = token
        at += token
    if kind != 3 and at < len(b):
        out["packet_length"], at = _varint(b, at)
    if kind == 0 and (host := _plain_host(b[at:])):
        out["sni"] = host
    return out, b"", None


def _plain_host(b: bytes) -> str | None:
    """A server name that stands in clear: the extension 0 with a host name entry."""
    at = b.find(b"\x00\x00")
    while at >= 0 and at + 9 <= len(b):
        n = u16(b, at + 7)
        if b[at + 6] == 0 and u16(b, at + 4) == n + 3 and u16(b, at + 2) == n + 5 and _HOST.fullmatch(b[at + 9 : at + 9 + n]):
            return b[at + 9 : at + 9 + n].decode()
        at = b.find(b"\x00\x00", at + 1)
    return None


@decoder("bgp", on(179), about="Border gateways")
def bgp(b: bytes, h: Hints) -> Layer:
    need(b, 19)
    size, kind = u16(b, 16), b[18]
    if b[:16] != b"\xff" * 16 or not 19 <= size <= 4096:
        raise Short()
    out: dict[str, Any] = {"message_type": kind, "message_type_name": BGP_MESSAGE.get(kind, "UNKNOWN"), "length": size}
    body = b[:size]
    if kind == 1:
        need(b, 29, out)
        out |= {"version": b[19], "my_as": u16(b, 20), "hold_time": u16(b, 22), "bgp_id": quad(b, 24)}
        found = []
        for code, v in _bgp_options(body[29:]):
            found.append(_BGP_CAPABILITY.get(code, str(code)))
            if code == 65 and len(v) == 4:
                out["my_as_4byte"] = u32(v, 0)
        if found:
            out["capabilities"] = ",".join(found)
    elif kind == 2:
        need(b, 21, out)
        out["withdrawn_routes_len"] = n = u16(b, 19)
        at = 21 + n
        need(b, at + 2, out)
        out["path_attr_len"] = m = u16(b, at)
        for name, part in (("withdrawn_routes", body[21:at]), ("nlri", body[at + 2 + m :])):
            if routes := _bgp_routes(part):
                out |= {name: ",".join(routes), name.replace("_routes", "") + "_count": len(routes)}
        _bgp_attributes(body[at + 2 : at + 2 + m], out)
    elif kind == 3 and len(body) >= 21:
        out |= {"error_code": b[19], "error_code_name": _BGP_ERROR.get(b[19], "Unknown"), "error_subcode": b[20]}
    elif kind == 5 and len(body) >= 23:
        out |= {"afi": u16(b, 19), "safi": b[22]}
    return out, b"", None


def _bgp_options(b: bytes) -> list[tuple[int, bytes]]:
    """Capabilities in the optional parameters of an OPEN message."""
    out, at = [], 0
    while at + 2 <= len(b):
        kind, size = b[at], b[at + 1]
        inner, k = b[at + 2 : at + 2 + size], 0
        while kind == 2 and k + 2 <= len(inner):
            out.append((inner[k], inner[k + 2 : k + 2 + inner[k + 1]]))
            k += 2 + inner[k + 1]
        at += 2 + size
    return out


def _bgp_routes(b: bytes) -> list[str]:
    """Prefixes of version 4."""
    out, at = [], 0
    while at < len(b) and b[at] <= 32 and at + 1 + (n := (b[at] + 7) // 8) <= len(b):
        out.append(f"{quad(b[at + 1 : at + 1 + n] + bytes(4 - n))}/{b[at]}")
        at += 1 + n
    return out


def _bgp_attributes(b: bytes, out: dict[str, Any]) -> None:
    at = 0
    while at + 3 <= len(b):
        long = b[at] & 0x10
        if at + 3 + bool(long) > len(b):
            return
        kind, size = b[at + 1], u16(b, at + 2) if long else b[at + 2]
        at += 4 if long else 3
        v = b[at : at + size]
        at += size
        if kind == 1 and v:
            out |= {"origin": v[0], "origin_name": BGP_ORIGIN.get(v[0], "UNKNOWN")}
        elif kind == 2:
            # a speaker of four-byte numbers fills the segments exactly with them
            path = _as_path(v, 4) or _as_path(v, 2) or []
            out |= {"as_path": " ".join(path), "as_path_length": len(path)}
        elif kind == 3 and size == 4:
            out["next_hop"] = quad(v)
        elif kind in (4, 5) and size == 4:
            out["med" if kind == 4 else "local_pref"] = u32(v, 0)
        elif kind == 6:
            out["atomic_aggregate"] = True
        elif kind == 7 and size in (6, 8):
            out |= {"aggregator_as": int.from_bytes(v[:-4], "big"), "aggregator_ip": quad(v, size - 4)}
        elif kind in (14, 15) and size >= 3:
            out |= {"afi": u16(v, 0), "safi": v[2]}


def _as_path(v: bytes, width: int) -> list[str] | None:
    """Numbers of a path if its segments have this width; sets are in braces."""
    out, at = [], 0
    while at + 2 <= len(v):
        kind, n = v[at], v[at + 1]
        end = at + 2 + n * width
        if kind not in (1, 2, 3, 4) or end > len(v):
            return None
        numbers = [str(int.from_bytes(v[i : i + width], "big")) for i in range(at + 2, end, width)]
        out.extend(["{" + ",".join(numbers) + "}"] if kind == 1 else numbers)
        at = end
    return out if at == len(v) else None
