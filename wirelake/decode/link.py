"""Link layer: Ethernet, cooked Linux captures, VLAN, ARP, MPLS, netlink."""

from __future__ import annotations

import ipaddress
import struct
from typing import Any

from wirelake.decode.core import Hints, Layer, decoder, need, u16, u32

# fixed values
_PACKET_TYPE = {0: "HOST", 1: "BROADCAST", 2: "MULTICAST", 3: "OTHERHOST", 4: "OUTGOING"}
_ARPHRD = {1: "ETHER", 770: "FRAD", 772: "LOOPBACK", 778: "IPGRE", 803: "IEEE80211_RADIOTAP", 823: "IP6GRE", 824: "NETLINK"}
_NETLINK_FAMILY = {
    0: "ROUTE", 2: "USERSOCK", 3: "FIREWALL", 4: "SOCK_DIAG", 5: "NFLOG", 6: "XFRM", 7: "SELINUX", 8: "ISCSI", 9: "AUDIT", 10: "FIB_LOOKUP", 11: "CONNECTOR", 12: "NETFILTER", 13: "IP6_FW", 14: "DNRTMSG",
    15: "KOBJECT_UEVENT", 16: "GENERIC", 18: "SCSITRANSPORT", 19: "ECRYPTFS", 20: "RDMA", 21: "CRYPTO",
}
_MPLS_LABEL = {0: "IPv4 Explicit NULL", 1: "Router Alert", 2: "IPv6 Explicit NULL", 3: "Implicit NULL", 7: "Entropy Label Indicator", 13: "GAL", 14: "OAM Alert", 15: "Extension"}
_NETLINK_TYPE = {1: "NLMSG_NOOP", 2: "NLMSG_ERROR", 3: "NLMSG_DONE", 4: "NLMSG_OVERRUN"}
_ROUTE_TYPE = {
    16: "RTM_NEWLINK", 17: "RTM_DELLINK", 18: "RTM_GETLINK", 19: "RTM_SETLINK", 20: "RTM_NEWADDR", 21: "RTM_DELADDR", 22: "RTM_GETADDR", 24: "RTM_NEWROUTE", 25: "RTM_DELROUTE", 26: "RTM_GETROUTE",
    28: "RTM_NEWNEIGH", 29: "RTM_DELNEIGH", 30: "RTM_GETNEIGH",
}


@decoder("ethernet", lambda h: h.link_type == 1, about="Ethernet II")
def ethernet(b: bytes, h: Hints) -> Layer:
    need(b, 14)
    kind = u16(b, 12)
    return {"dst_mac": b[:6], "src_mac": b[6:12], "ethertype": kind}, b[14:], Hints(ethertype=kind)


@decoder("linux_sll", lambda h: h.link_type == 113, about="Linux cooked capture")
def linux_sll(b: bytes, h: Hints) -> Layer:
    need(b, 16)
    kind, device, size, protocol = u16(b, 0), u16(b, 2), u16(b, 4), u16(b, 14)
    out = {
        "packet_type": kind, "packet_type_name": _PACKET_TYPE.get(kind, "UNKNOWN"), "arphrd_type": device, "arphrd_name": _ARPHRD.get(device, "UNKNOWN"), "addr_len": size,
        "addr": b[6 : 6 + min(size, 8)] if size else None, "protocol": protocol,
    }
    if device == 824:
        return out, b[16:], Hints(family=protocol, extra={"netlink": True})
    return out, b[16:], Hints(ethertype=protocol) if device in (1, 772) else None


@decoder("arp", lambda h: h.ethertype == 0x0806, about="Address resolution")
def arp(b: bytes, h: Hints) -> Layer:
    need(b, 28)
    hardware, protocol, op = u16(b, 0), u16(b, 2), u16(b, 6)
    out: dict[str, Any] = {"hardware_type": hardware, "protocol_type": protocol, "hardware_size": b[4], "protocol_size": b[5], "operation": op, "operation_name": {1: "Request", 2: "Reply"}.get(op, "Unknown")}
    if (hardware, protocol, b[4], b[5]) == (1, 0x0800, 6, 4):
        out |= {"sender_mac": b[8:14], "sender_ip": u32(b, 14), "target_mac": b[18:24], "target_ip": u32(b, 24)}
    return out, b[28:], None


@decoder("vlan", lambda h: h.ethertype in (0x8100, 0x88A8), about="VLAN tag")
def vlan(b: bytes, h: Hints) -> Layer:
    need(b, 4)
    tci, inner = u16(b, 0), u16(b, 2)
    return {"vlan_id": tci & 0xFFF, "priority": tci >> 13, "dei": bool(tci & 0x1000), "inner_ethertype": inner}, b[4:], Hints(ethertype=inner)


@decoder("mpls", lambda h: h.ethertype in (0x8847, 0x8848), about="Label stack")
def mpls(b: bytes, h: Hints) -> Layer:
    stack, at = [], 0
    while True:
        need(b, at + 4)
        entry = u32(b, at)
        at += 4
        stack.append(entry)
        if entry & 0x100:
            break
    top, rest = stack[0], b[at:]
    out = {
        "label": top >> 12, "tc": (top >> 9) & 7, "bottom": bool(stack[-1] & 0x100), "ttl": top & 0xFF, "stack_depth": len(stack), "labels": ",".join(str(e >> 12) for e in stack),
    }
    out |= {"is_reserved_label": top >> 12 < 16, "special_label_name": _MPLS_LABEL.get(top >> 12)}
    inner = {4: 0x0800, 6: 0x86DD}.get(rest[0] >> 4) if rest else None
    return out, rest, Hints(ethertype=inner, tunnel=("mpls", top >> 12)) if inner else None


@decoder("netlink", lambda h: h.link_type == 253 or bool(h.extra.get("netlink")), about="Netlink message")
def netlink(b: bytes, h: Hints) -> Layer:
    need(b, 16)
    size, kind, flags, seq, pid = struct.unpack("<IHHII", b[:16])
    family = h.family if h.family is not None else 0
    out = {
        "msg_len": size, "msg_type": kind, "msg_flags": flags, "msg_seq": seq, "msg_pid": pid, "msg_type_name": _NETLINK_TYPE.get(kind, "PROTOCOL_SPECIFIC"), "is_request": bool(flags & 1),
        "is_multipart": bool(flags & 2), "is_ack": bool(flags & 4), "is_echo": bool(flags & 8), "family": family & 0xFF, "family_name": _NETLINK_FAMILY.get(family, "UNKNOWN"),
    }
    body = b[16 : max(16, size)]
    return out, body, Hints(family=family, extra={"rt_type": kind}) if family == 0 else None


@decoder("rtnetlink", lambda h: h.parent == "netlink" and h.family == 0 and "rt_type" in h.extra, about="Routing message")
def rtnetlink(b: bytes, h: Hints) -> Layer:
    kind = h.extra["rt_type"]
    out: dict[str, Any] = {"msg_type": kind, "msg_type_name": _ROUTE_TYPE.get(kind, "UNKNOWN")}
    if 16 <= kind <= 19:
        need(b, 16, out)
        _, device, index, flags, _ = struct.unpack("<BxHiII", b[:16])
        out |= {"link_index": index & 0xFFFFFFFF, "link_type": device, "link_flags": flags}
        for attr, v in _attributes(b[16:]):
            if attr == 3:
                out["if_name"] = v.rstrip(b"\0").decode("utf-8", "replace")
            elif attr == 4 and len(v) >= 4:
                out["mtu"] = int.from_bytes(v[:4], "little")
            elif attr == 1:
                out["hw_addr"] = v
    elif 20 <= kind <= 22:
        need(b, 8, out)
        out |= {"addr_family": b[0], "addr_family_name": {2: "IPv4", 10: "IPv6"}.get(b[0], "Unknown"), "prefix_len": b[1], "addr_index": int.from_bytes(b[4:8], "little")}
        for attr, v in _attributes(b[8:]):
            if attr in (1, 2):
                out["address" if attr == 1 else "local_addr"] = _ip(v)
            elif attr == 3:
                out["if_name"] = v.rstrip(b"\0").decode("utf-8", "replace")
    elif 24 <= kind <= 26:
        need(b, 12, out)
        out |= {"route_family": b[0], "dst_prefix_len": b[1], "src_prefix_len": b[2], "route_table": b[4], "route_protocol": b[5], "route_scope": b[6], "route_type": b[7]}
        for attr, v in _attributes(b[12:]):
            if attr in (1, 5):
                out["destination" if attr == 1 else "gateway"] = _ip(v)
            elif attr == 4 and len(v) >= 4:
                out["oif_index"] = int.from_bytes(v[:4], "little")
    return out, b"", None


def _attributes(b: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at + 4 <= len(b):
        size, kind = struct.unpack("<HH", b[at : at + 4])
        if size < 4 or at + size > len(b):
            break
        out.append((kind & 0x3FFF, b[at + 4 : at + size]))
        at += (size + 3) // 4 * 4
    return out


def _ip(v: bytes) -> str | None:
    return str(ipaddress.ip_address(v)) if len(v) in (4, 16) else None
