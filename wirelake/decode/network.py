"""Network, transport and tunnel layers."""

from __future__ import annotations

from typing import Any

from wirelake.decode.core import Hints, Layer, Short, decoder, need, quad, u16, u32
from wirelake.functions.names import ICMP_TYPE, ICMPV6_TYPE, OSPF_LSA, OSPF_PACKET

#: IP protocol -> tunnel, by the version of the outer header
_IP_TUNNELS = {4: {4: "ipinip", 41: "ip6inip"}, 6: {4: "ip4inip6", 41: "ip6inip6"}}

# fixed values
_GTP_EXTENSION = {
    0x01: "MBMS Support Indication", 0x02: "MS Info Change Reporting", 0x20: "Service Class Indicator", 0x40: "UDP Port", 0x81: "RAN Container", 0x82: "Long PDCP PDU Number", 0x83: "Xw RAN Container",
    0x84: "NR RAN Container", 0x85: "PDU Session Container", 0xC0: "PDCP PDU Number",
}


def _carried(protocol: int, version: int) -> Hints:
    """Hints below an IP header: another IP packet, or a transport."""
    if kind := _IP_TUNNELS[version].get(protocol):
        return Hints(ethertype=0x0800 if protocol == 4 else 0x86DD, tunnel=(kind, None))
    return Hints(ip_protocol=protocol, ip_version=version)


@decoder("ipv4", lambda h: h.ethertype == 0x0800, about="Internet protocol version 4")
def ipv4(b: bytes, h: Hints) -> Layer:
    need(b, 20)
    ihl = b[0] & 15
    need(b, max(ihl * 4, 20))
    if b[0] >> 4 != 4 or ihl < 5:
        raise Short()
    total, frag = u16(b, 2), u16(b, 6)
    out = {
        "version": b[0] >> 4, "ihl": ihl, "dscp": b[1] >> 2, "ecn": b[1] & 3, "total_length": total, "identification": u16(b, 4), "dont_fragment": bool(frag & 0x4000), "more_fragments": bool(frag & 0x2000),
        "fragment_offset": frag & 0x1FFF, "ttl": b[8], "protocol": b[9], "checksum": u16(b, 10), "src_ip": u32(b, 12), "dst_ip": u32(b, 16),
    }
    # what follows the packet in the frame is padding; offloaded packets say 0
    end = total if ihl * 4 <= total <= len(b) else len(b)
    # a later fragment has no transport header
    return out, b[ihl * 4 : end], _carried(b[9], 4) if frag & 0x1FFF == 0 else None


@decoder("ipv6", lambda h: h.ethertype == 0x86DD, about="Internet protocol version 6")
def ipv6(b: bytes, h: Hints) -> Layer:
    need(b, 40)
    if b[0] >> 4 != 6:
        raise Short()
    head, size, nxt = u32(b, 0), u16(b, 4), b[6]
    out = {"version": 6, "traffic_class": (head >> 20) & 0xFF, "flow_label": head & 0xFFFFF, "payload_length": size, "next_header": nxt, "hop_limit": b[7], "src_ip": b[8:24], "dst_ip": b[24:40]}
    rest = b[40 : 40 + size] if 0 < size <= len(b) - 40 else b[40:]
    out |= {"ext_hop_by_hop": False, "ext_routing": False, "ext_fragment": False, "ext_destination": False}
    # hop-by-hop, routing, fragment, destination options, mobility; authentication is a layer of its own
    while nxt in (0, 43, 44, 60, 135) and len(rest) >= 8:
        if name := {0: "ext_hop_by_hop", 43: "ext_routing", 44: "ext_fragment", 60: "ext_destination"}.get(nxt):
            out[name] = True
        if nxt == 43:
            out |= {"routing_type": rest[2], "segments_left": rest[3]}
        if nxt == 44:
            out |= {"frag_offset": u16(rest, 2) >> 3, "frag_more": bool(rest[3] & 1), "frag_id": u32(rest, 4)}
            if u16(rest, 2) & 0xFFF8:
                return out, rest, None
            length = 8
        else:
            length = (rest[1] + 1) * 8
        nxt, rest = rest[0], rest[length:]
    return out, rest, _carried(nxt, 6)


@decoder("tcp", lambda h: h.ip_protocol == 6, about="Transmission control protocol")
def tcp(b: bytes, h: Hints) -> Layer:
    need(b, 20)
    offset, flags = (b[12] >> 4) * 4, u16(b, 12) & 0x1FF
    out: dict[str, Any] = {
        "src_port": u16(b, 0), "dst_port": u16(b, 2), "seq": u32(b, 4), "ack": u32(b, 8), "data_offset": b[12] >> 4, "flags": flags, "flag_fin": bool(flags & 1), "flag_syn": bool(flags & 2),
        "flag_rst": bool(flags & 4), "flag_psh": bool(flags & 8), "flag_ack": bool(flags & 16), "flag_urg": bool(flags & 32), "window": u16(b, 14), "checksum": u16(b, 16), "urgent_ptr": u16(b, 18),
    }
    if offset < 20 or offset > len(b):
        raise Short(out)
    out["options_length"] = offset - 20
    if offset > 20:
        out |= _tcp_options(b[20:offset])
    return out, b[offset:], Hints(transport="tcp", src_port=out["src_port"], dst_port=out["dst_port"])


def _tcp_options(o: bytes) -> dict[str, Any]:
    out: dict[str, Any] = {}
    seen, at = [], 0
    while at < len(o) and o[at] != 0:
        kind = o[at]
        if kind == 1:
            at += 1
            continue
        if at + 1 >= len(o) or o[at + 1] < 2 or at + o[at + 1] > len(o):
            break
        body = o[at + 2 : at + o[at + 1]]
        at += o[at + 1]
        if kind == 2 and len(body) == 2:
            seen.append("MSS")
            out["mss"] = u16(body, 0)
        elif kind == 3 and len(body) == 1:
            seen.append("WS")
            out["window_scale"] = body[0]
        elif kind == 4:
            seen.append("SACK_PERM")
            out["sack_permitted"] = True
        elif kind == 5:
            seen.append("SACK")
            edges = [u32(body, i) for i in range(0, len(body) - 3, 4)]
            out["sack_left_edges"], out["sack_right_edges"] = edges[0::2], edges[1::2]
        elif kind == 8 and len(body) == 8:
            seen.append("TS")
            out["ts_val"], out["ts_ecr"] = u32(body, 0), u32(body, 4)
    if seen:
        # the usual order, whatever the order on the wire
        out["options"] = ",".join(x for x in ("MSS", "WS", "SACK_PERM", "SACK", "TS") if x in seen)
    return out


@decoder("udp", lambda h: h.ip_protocol == 17, about="User datagram protocol")
def udp(b: bytes, h: Hints) -> Layer:
    need(b, 8)
    size = u16(b, 4)
    out = {"src_port": u16(b, 0), "dst_port": u16(b, 2), "length": size, "checksum": u16(b, 6)}
    rest = b[8:size] if 8 <= size <= len(b) else b[8:]
    return out, rest, Hints(transport="udp", src_port=out["src_port"], dst_port=out["dst_port"])


@decoder("icmp", lambda h: h.ip_protocol == 1, about="Control messages")
def icmp(b: bytes, h: Hints) -> Layer:
    need(b, 8)
    kind, code = b[0], b[1]
    # the column says Timestamp Request and knows only the classic types
    name = "Timestamp Request" if kind == 13 else ICMP_TYPE.get(kind, "Unknown") if kind <= 18 and kind != 6 else "Unknown"
    out: dict[str, Any] = {"type": kind, "code": code, "checksum": u16(b, 2), "type_name": name}
    if kind in (0, 8):
        out |= {"identifier": u16(b, 4), "sequence": u16(b, 6)}
    elif (kind, code) == (3, 4):
        out["next_hop_mtu"] = u16(b, 6)
    elif kind == 5:
        out["gateway"] = u32(b, 4)
    return out, b[8:], None


@decoder("icmpv6", lambda h: h.ip_protocol == 58 and h.ip_version == 6, about="Control messages of version 6")
def icmpv6(b: bytes, h: Hints) -> Layer:
    need(b, 4)
    kind = b[0]
    out: dict[str, Any] = {"type": kind, "code": b[1], "checksum": u16(b, 2), "type_name": ICMPV6_TYPE.get(kind, "Unknown")}
    options = None
    if kind in (128, 129):
        need(b, 8, out)
        out |= {"echo_id": u16(b, 4), "echo_seq": u16(b, 6)}
    elif kind in (2, 4):
        need(b, 8, out)
        out["mtu" if kind == 2 else "pointer"] = u32(b, 4)
    elif kind == 133:
        options = 8
    elif kind == 134:
        need(b, 16, out)
        out |= {"ndp_cur_hop_limit": b[4], "ndp_managed_flag": bool(b[5] & 128), "ndp_other_flag": bool(b[5] & 64), "ndp_router_lifetime": u16(b, 6), "ndp_reachable_time": u32(b, 8), "ndp_retrans_timer": u32(b, 12)}
        options = 16
    elif kind in (135, 136, 137):
        need(b, 24, out)
        out["ndp_target_address"] = b[8:24]
        if kind == 136:
            out |= {"ndp_router_flag": bool(b[4] & 128), "ndp_solicited_flag": bool(b[4] & 64), "ndp_override_flag": bool(b[4] & 32)}
        options = 40 if kind == 137 else 24
    elif kind in (130, 131, 132):
        need(b, 24, out)
        out |= {"mld_max_response_delay": u16(b, 4), "mld_multicast_address": b[8:24]}
    elif kind == 143:
        need(b, 8, out)
        out["mld_num_group_records"] = u16(b, 6)
    while options is not None and options + 2 <= len(b) and b[options + 1]:
        body = b[options + 2 : options + b[options + 1] * 8]
        if b[options] in (1, 2) and len(body) >= 6:
            out["ndp_source_mac" if b[options] == 1 else "ndp_target_mac"] = body[:6]
        elif b[options] == 3 and len(body) >= 30:
            out |= {"ndp_prefix_length": body[0], "ndp_prefix": body[14:30]}
        elif b[options] == 5 and len(body) >= 6:
            out["mtu"] = u32(body, 2)
        options += b[options + 1] * 8
    return out, b"", None


@decoder("gre", lambda h: h.ip_protocol == 47, about="Generic routing encapsulation")
def gre(b: bytes, h: Hints) -> Layer:
    need(b, 4)
    flags, protocol, at = u16(b, 0), u16(b, 2), 4
    out: dict[str, Any] = {"checksum_present": bool(flags & 0x8000), "key_present": bool(flags & 0x2000), "sequence_present": bool(flags & 0x1000), "version": flags & 7, "protocol": protocol}
    for bit, name in ((0x8000, "checksum"), (0x2000, "key"), (0x1000, "sequence")):
        if flags & bit:
            need(b, at + 4, out)
            out[name] = u16(b, at) if name == "checksum" else u32(b, at)
            at += 4
    out |= {"version_name": {0: "GRE", 1: "PPTP"}.get(flags & 7, "Unknown"), "header_length": at}
    # Ethernet in GRE goes on with a link header
    nxt = Hints(link_type=1) if protocol == 0x6558 else Hints(ethertype=protocol)
    nxt.tunnel = ("gre", out.get("key"))
    return out, b[at:], nxt


@decoder("vxlan", lambda h: h.dst_port == 4789, about="Virtual networks over UDP", ports=(4789,))
def vxlan(b: bytes, h: Hints) -> Layer:
    need(b, 8)
    vni = u32(b, 4) >> 8
    return {"flags": b[0], "vni": vni, "i_flag_valid": bool(b[0] & 8), "flags_valid": b[0] == 8, "inner_frame_length": len(b) - 8}, b[8:], Hints(link_type=1, tunnel=("vxlan", vni))


@decoder("gtp", lambda h: h.dst_port in (2152, 2123), about="Tunnels of mobile networks", ports=(2152, 2123))
def gtp(b: bytes, h: Hints) -> Layer:
    need(b, 8)
    version, kind = b[0] >> 5, b[1]
    out: dict[str, Any] = {"version": version, "protocol_type": (b[0] >> 4) & 1, "message_type": kind, "length": u16(b, 2)}
    if version == 2:
        out |= {"piggyback": bool(b[0] & 16), "teid_present": bool(b[0] & 8)}
        if b[0] & 8:
            need(b, 12, out)
            out |= {"teid": u32(b, 4), "sequence": int.from_bytes(b[8:11], "big") & 0xFFFF}
            return out, b[12:], None
        out["sequence"] = int.from_bytes(b[4:7], "big") & 0xFFFF
        return out, b[8:], None
    out["teid"] = u32(b, 4)
    at = 8
    if b[0] & 7:
        need(b, 12, out)
        if b[0] & 2:
            out["sequence"] = u16(b, 8)
        if b[0] & 1:
            out["npdu"] = b[10]
        ext, at, seen = b[11] if b[0] & 4 else 0, 12, []
        while ext and at < len(b) and b[at]:
            size = b[at] * 4
            seen.append(_GTP_EXTENSION.get(ext, f"0x{ext:02x}"))
            out |= {"extension_headers": ",".join(seen), "extension_header_count": len(seen)}
            need(b, at + size, out)
            ext, at = b[at + size - 1], at + size
    rest = b[at:]
    inner = {4: 0x0800, 6: 0x86DD}.get(rest[0] >> 4) if rest and kind == 255 else None
    return out, rest, Hints(ethertype=inner, tunnel=("gtp", out["teid"])) if inner else None


@decoder("ipsec", lambda h: h.ip_protocol in (50, 51), about="Encrypted and authenticated IP")
def ipsec(b: bytes, h: Hints) -> Layer:
    if h.ip_protocol == 50:
        need(b, 8, {"protocol": "ESP"})
        return {"protocol": "ESP", "spi": u32(b, 0), "sequence": u32(b, 4)}, b[8:], None
    need(b, 12, {"protocol": "AH"})
    size = (b[1] + 2) * 4
    out = {"protocol": "AH", "ah_next_header": b[0], "ah_icv_length": max(size - 12, 0), "spi": u32(b, 4), "sequence": u32(b, 8)}
    need(b, size, out)
    return out, b[size:], _carried(b[0], h.ip_version or 4)


@decoder("ospf", lambda h: h.ip_protocol == 89, about="Link state routing")
def ospf(b: bytes, h: Hints) -> Layer:
    need(b, 16)
    version, kind = b[0], b[1]
    out: dict[str, Any] = {"version": version, "message_type": kind, "message_type_name": OSPF_PACKET.get(kind, "Unknown"), "length": u16(b, 2), "router_id": quad(b, 4), "area_id": quad(b, 8)}
    if version == 2:
        need(b, 24, out)
        out["auth_type"] = u16(b, 14)
        if kind == 1 and len(b) >= 44:
            out |= {"hello_interval": u16(b, 28), "dead_interval": u32(b, 32), "designated_router": quad(b, 36), "backup_dr": quad(b, 40), "neighbor_count": (len(b[:out["length"]]) - 44) // 4}
        body = b[24 : max(24, out["length"])]
        lsa = None
        if kind == 2 and len(body) >= 8:
            out |= {"dd_interface_mtu": u16(body, 0), "dd_options": body[2], "dd_flags": body[3], "dd_sequence": u32(body, 4), "dd_lsa_count": (len(body) - 8) // 20}
            lsa = body[8:28]
        elif kind == 4 and len(body) >= 4:
            out["lsu_lsa_count"] = u32(body, 0)
            lsa = body[4:24]
        elif kind == 5:
            out["lsa_ack_count"] = len(body) // 20
            lsa = body[:20]
        if lsa is not None and len(lsa) == 20:
            out |= {"lsa_age": u16(lsa, 0), "lsa_type": lsa[3], "lsa_type_name": OSPF_LSA.get(lsa[3], "Unknown"), "lsa_id": quad(lsa, 4), "lsa_advertising_router": quad(lsa, 8), "lsa_sequence": u32(lsa, 12)}
    return out, b"", None
