from __future__ import annotations

import hashlib
import struct

import packets as P
from wirelake.decode import core, tables  # noqa: F401


def decoded(frame: bytes, link: int = 1) -> dict[str, list]:
    out: dict[str, list] = {}
    for name, depth, kind, ident, f in core.layers(frame, link):
        out.setdefault(name, []).append((depth, kind, ident, f))
    return out


def only(frame: bytes, name: str, link: int = 1) -> dict:
    return decoded(frame, link)[name][0][3]


def test_syn():
    d = decoded(P.eth(P.ip(P.tcp(12345, 80), 6)))
    assert list(d) == ["ethernet", "ipv4", "tcp"]
    assert d["ipv4"][0][3]["ttl"] == 64 and d["ipv4"][0][3]["src_ip"] == 3232235876 and d["ipv4"][0][3]["dont_fragment"]
    t = d["tcp"][0][3]
    assert (t["flags"], t["seq"], t["window"], t["flag_syn"], t["options_length"]) == (2, 1, 65535, True, 0) and "options" not in t


def test_tcp_options():
    o = b"\x08\x0a" + struct.pack(">II", 1, 2) + b"\x02\x04\x05\xb4\x03\x03\x07\x04\x02\x05\x0a" + struct.pack(">II", 100, 200)
    t = only(P.eth(P.ip(P.tcp(1, 2, options=o), 6)), "tcp")
    assert t["options"] == "MSS,WS,SACK_PERM,SACK,TS" and (t["mss"], t["window_scale"], t["ts_val"], t["ts_ecr"]) == (1460, 7, 1, 2) and t["sack_left_edges"] == [100] and t["sack_right_edges"] == [200]


def test_dns():
    q = only(P.eth(P.ip(P.udp(4000, 53, P.dns_query("Example.test")), 17)), "dns")
    assert q["is_query"] and q["query_name"] == "Example.test" and q["answer_ip4s"] == [] and not q["has_edns"]
    a = only(P.eth(P.ip(P.udp(53, 4000, P.dns_answer("a.test")), 17)), "dns")
    assert a["answer_ip4s"] == [167772167] and a["answer_cnames"] == ["alias.test"] and a["answer_types"] == [5, 1, 28] and a["answer_ttls"] == [300] * 3 and a["edns_udp_size"] == 1232 and len(a["answer_ip6s"][0]) == 16
    over_tcp = P.dns_query("b.test")
    assert only(P.eth(P.ip(P.tcp(4000, 53, flags=24, payload=struct.pack(">H", len(over_tcp)) + over_tcp), 6)), "dns")["query_name"] == "b.test"


def test_arp_vlan_icmp():
    arp = struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + P.MAC_A + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 2])
    assert only(P.eth(arp, 0x0806), "arp")["operation_name"] == "Request" and only(P.eth(arp, 0x0806), "arp")["target_ip"] == 167772162
    d = decoded(P.eth(struct.pack(">HH", 0x2064, 0x8100) + struct.pack(">HH", 0x0005, 0x0800) + P.ip(P.udp(1, 2, b""), 17), 0x88A8))
    assert [(x[0], x[3]["vlan_id"], x[3]["priority"]) for x in d["vlan"]] == [(0, 100, 1), (0, 5, 0)] and "udp" in d
    for kind, code, rest, key, want in ((8, 0, struct.pack(">HH", 3, 4), "sequence", 4), (3, 4, struct.pack(">HH", 0, 1400), "next_hop_mtu", 1400), (5, 0, bytes([10, 0, 0, 9]), "gateway", 167772169)):
        assert only(P.eth(P.ip(struct.pack(">BBH", kind, code, 0) + rest, 1)), "icmp")[key] == want


def test_tunnels():
    inner = P.ip(P.tcp(5, 6), 6, "10.1.1.1", "10.1.1.2")
    d = decoded(P.eth(P.ip(P.udp(9, 4789, b"\x08\0\0\0" + (100 << 8).to_bytes(4, "big") + P.eth(inner)), 17)))
    assert [(x[0], x[1], x[2]) for x in d["ipv4"]] == [(0, None, None), (1, "vxlan", 100)] and d["vxlan"][0][0] == 0 and d["tcp"][0][0] == 1
    gre = struct.pack(">HHI", 0x2000, 0x0800, 77)
    assert decoded(P.eth(P.ip(gre + inner, 47)))["ipv4"][1][:3] == (1, "gre", 77)
    mpls = b"".join(((label << 12) | (last << 8) | 9).to_bytes(4, "big") for label, last in ((16, 0), (17, 0), (18, 1)))
    d = decoded(P.eth(mpls + inner, 0x8847))
    assert d["mpls"][0][3]["labels"] == "16,17,18" and d["ipv4"][0][:3] == (1, "mpls", 16)
    gtp = struct.pack(">BBHI", 0x30, 255, len(inner), 42)
    assert decoded(P.eth(P.ip(P.udp(1, 2152, gtp + inner), 17)))["ipv4"][1][:3] == (1, "gtp", 42)
    for outer, proto, body, kind in ((P.ip, 4, inner, "ipinip"), (P.ip, 41, P.ip6(b"", 59), "ip6inip"), (P.ip6, 4, inner, "ip4inip6"), (P.ip6, 41, P.ip6(b"", 59), "ip6inip6")):
        d = decoded(P.eth(outer(body, proto), 0x0800 if outer is P.ip else 0x86DD))
        assert any(x[:3] == (1, kind, None) for n in ("ipv4", "ipv6") for x in d.get(n, []))
    deep = P.ip(gre + P.ip(P.udp(9, 4789, b"\x08\0\0\0\0\0\1\0" + P.eth(inner)), 17), 47)
    assert [x[0] for x in decoded(P.eth(deep))["ipv4"]] == [0, 1, 2]


def test_tls_and_quic():
    hello = P.record(22, P.client_hello(bytes(32)))
    t = only(P.eth(P.ip(P.tcp(4000, 443, flags=24, payload=hello), 6)), "tls")
    want = "771,4865-49199,0-10-11-16,29,0"
    assert t["ja3"] == want and t["ja3_hash"] == hashlib.md5(want.encode()).hexdigest() and (t["sni"], t["alpn"], t["cipher_suite_count"]) == ("www.test", "h2", 3)
    assert only(P.eth(P.ip(P.tcp(443, 4000, flags=24, payload=P.record(22, P.server_hello(bytes(32), 0x1301))), 6)), "tls")["selected_cipher"] == "TLS_AES_128_GCM_SHA256"
    assert only(P.eth(P.ip(P.tcp(443, 4000, flags=24, payload=P.record(21, b"\2\x28")), 6)), "tls")["alert_description_str"] == "handshake_failure"
    assert only(P.eth(P.ip(P.tcp(443, 4000, flags=24, payload=P.record(23, bytes(50))), 6)), "tls")["app_data_length"] == 50
    assert only(P.eth(P.ip(P.tcp(443, 4000, flags=24, payload=P.record(23, bytes(50))[:20]), 6)), "tls") == {"record_type": 23, "record_version": 771, "version": "TLS 1.2"}
    quic = bytes([0xC0]) + struct.pack(">I", 1) + b"\x08" + bytes(8) + b"\x00" + b"\x00" + b"\x40\x10" + bytes(16)
    d = decoded(P.eth(P.ip(P.udp(5000, 443, quic), 17)))
    assert "tls" not in d and d["quic"][0][3]["version_name"] == "QUIC v1" and d["quic"][0][3]["packet_length"] == 16 and d["quic"][0][3]["long_packet_type"] == "Initial"
    # the padding of a short frame is no TLS
    bare = P.eth(P.ip(P.tcp(4000, 443, flags=16), 6))
    assert "tls" not in decoded(bare + bytes(6))


def test_other_protocols():
    dhcp = bytes([1, 1, 6, 0]) + struct.pack(">IHHIIII", 9, 0, 0, 0, 0xC0A80105, 0, 0) + P.MAC_A + bytes(10) + bytes(192) + b"\x63\x82\x53\x63" + b"\x35\1\1" + b"\x01\4\xff\xff\xff\0" + b"\x06\4\x08\x08\x08\x08" + b"\xff"
    d = only(P.eth(P.ip(P.udp(68, 67, dhcp), 17)), "dhcp")
    assert d["message_type"] == 1 and d["yiaddr"] == 0xC0A80105 and d["chaddr"] == P.MAC_A and d["dns_servers"] == "8.8.8.8" and d["subnet_mask"] == 0xFFFFFF00
    ntp = bytes([0x23, 1, 6, 0xEC]) + struct.pack(">II", 1 << 15, 0) + b"GPS\0" + bytes(32)
    n = only(P.eth(P.ip(P.udp(123, 123, ntp), 17)), "ntp")
    assert (n["version"], n["mode"], n["precision"], n["reference_id"], n["root_delay"]) == (4, 3, -20, "GPS", 0.5)
    assert only(P.eth(P.ip(P.tcp(4000, 22, flags=24, payload=b"SSH-2.0-OpenSSH_9 hi\r\n"), 6)), "ssh")["software_version"] == "OpenSSH_9"
    bgp = b"\xff" * 16 + struct.pack(">HB", 29, 1) + struct.pack(">BHHIB", 4, 65000, 180, 0x0A000001, 0)
    assert only(P.eth(P.ip(P.tcp(4000, 179, flags=24, payload=bgp), 6)), "bgp")["bgp_id"] == "10.0.0.1"
    ospf = struct.pack(">BBHIIHHQ", 2, 1, 44, 0x01010101, 0, 0, 0, 0) + struct.pack(">IHBBIII", 0xFFFFFF00, 10, 0, 1, 40, 0x0A000001, 0x0A000002)
    o = only(P.eth(P.ip(ospf, 89)), "ospf")
    assert (o["hello_interval"], o["dead_interval"], o["designated_router"], o["message_type_name"]) == (10, 40, "10.0.0.1", "Hello")
    ah = struct.pack(">BBHII", 6, 4, 0, 5, 6) + bytes(12)
    d = decoded(P.eth(P.ip(ah + P.tcp(1, 2), 51)))
    assert d["ipsec"][0][3]["ah_icv_length"] == 12 and "tcp" in d
    assert only(P.eth(P.ip(struct.pack(">II", 8, 9) + bytes(20), 50)), "ipsec")["spi"] == 8


def test_icmpv6_and_extension_headers():
    ns = struct.pack(">BBHI", 135, 0, 0, 0) + bytes(15) + b"\5" + b"\1\1" + P.MAC_A
    i = only(P.eth(P.ip6(ns, 58), 0x86DD), "icmpv6")
    assert i["ndp_target_address"][-1] == 5 and i["ndp_source_mac"] == P.MAC_A
    hop = struct.pack(">BB6x", 44, 0) + struct.pack(">BBHI", 58, 0, 0, 7) + struct.pack(">BBHHH", 128, 0, 0, 1, 2)
    d = decoded(P.eth(P.ip6(hop, 0), 0x86DD))
    assert d["ipv6"][0][3]["next_header"] == 0 and d["icmpv6"][0][3]["echo_seq"] == 2


def test_netlink():
    link = struct.pack("<BxHiII", 0, 1, 3, 0x1043, 0) + struct.pack("<HH", 9, 3) + b"eth0\0\0\0\0" + struct.pack("<HHI", 8, 4, 1500)
    message = struct.pack("<IHHII", 16 + len(link), 16, 3, 1, 0) + link
    d = decoded(message, 253)
    assert d["rtnetlink"][0][3]["if_name"] == "eth0" and d["rtnetlink"][0][3]["mtu"] == 1500 and d["netlink"][0][3]["is_request"]
    sll = struct.pack(">HHH8sH", 0, 824, 0, bytes(8), 0) + message
    assert "rtnetlink" in decoded(sll, 113)
    assert "ipv4" in decoded(struct.pack(">HHH8sH", 4, 1, 6, P.MAC_A + bytes(2), 0x0800) + P.ip(P.udp(1, 2, b""), 17), 113)


def test_cut_off_headers_give_rows():
    whole = P.eth(P.ip(P.tcp(1, 2), 6))
    assert [n for n, *_ in core.layers(whole[:20], 1)] == ["ethernet", "ipv4"] and list(core.layers(whole[:20], 1))[1][4] == {}
    for frame in (whole, P.eth(P.ip(P.udp(53, 1, P.dns_answer("a.test")), 17)), P.eth(P.ip(P.tcp(4000, 443, flags=24, payload=P.record(22, P.client_hello(bytes(32)))), 6))):
        for n in range(len(frame)):
            list(core.layers(frame[:n], 1))
    assert list(core.layers(b"", 1)) == [] and list(core.layers(whole, 999)) == []


def test_extended_fields():
    attrs = bytes([0x40, 1, 1, 0]) + bytes([0x40, 2, 10, 2, 2]) + struct.pack(">II", 65001, 70000) + bytes([0x40, 3, 4, 10, 0, 0, 1]) + bytes([0x80, 4, 4]) + struct.pack(">I", 50) + bytes([0x40, 6, 0]) + bytes([0xC0, 7, 8]) + struct.pack(">I", 65001) + bytes([9, 9, 9, 9])
    update = struct.pack(">H", 3) + bytes([16, 172, 16]) + struct.pack(">H", len(attrs)) + attrs + bytes([24, 10, 1, 2, 8, 11])
    message = b"\xff" * 16 + struct.pack(">HB", 19 + len(update), 2) + update
    g = only(P.eth(P.ip(P.tcp(4000, 179, flags=24, payload=message), 6)), "bgp")
    assert (g["origin_name"], g["as_path"], g["as_path_length"], g["next_hop"], g["med"], g["atomic_aggregate"], g["aggregator_ip"]) == ("IGP", "65001 70000", 2, "10.0.0.1", 50, True, "9.9.9.9")
    assert (g["nlri"], g["nlri_count"], g["withdrawn_routes"], g["withdrawn_count"]) == ("10.1.2.0/24,11.0.0.0/8", 2, "172.16.0.0/16", 1)
    two = bytes([0x40, 2, 6, 2, 2]) + struct.pack(">HH", 1, 2)
    two = struct.pack(">HH", 0, len(two)) + two
    assert only(P.eth(P.ip(P.tcp(4000, 179, flags=24, payload=b"\xff" * 16 + struct.pack(">HB", 19 + len(two), 2) + two), 6)), "bgp")["as_path"] == "1 2"
    opened = struct.pack(">BHHIB", 4, 23456, 180, 1, 8) + bytes([2, 6, 65, 4]) + struct.pack(">I", 70000)
    o = only(P.eth(P.ip(P.tcp(4000, 179, flags=24, payload=b"\xff" * 16 + struct.pack(">HB", 19 + len(opened), 1) + opened), 6)), "bgp")
    assert o["my_as_4byte"] == 70000 and o["capabilities"] == "4-byte AS"
    assert only(P.eth(P.ip(P.tcp(4000, 179, flags=24, payload=b"\xff" * 16 + struct.pack(">HBBB", 21, 3, 6, 2)), 6)), "bgp")["error_code_name"] == "Cease"
    lsa = struct.pack(">HBBIIIHH", 1, 0, 1, 0x01010101, 0x02020202, 0x80000001, 0, 20)
    packet = struct.pack(">BBHIIHHQ", 2, 4, 24 + 4 + 20, 1, 0, 0, 0, 0) + struct.pack(">I", 1) + lsa
    assert only(P.eth(P.ip(packet, 89)), "ospf")["lsa_type_name"] == "Router-LSA"
    hop = struct.pack(">BB6x", 44, 0) + struct.pack(">BBHI", 58, 0, 1, 7) + struct.pack(">BBHHH", 128, 0, 0, 1, 2)
    six = only(P.eth(P.ip6(hop, 0), 0x86DD), "ipv6")
    assert six["ext_hop_by_hop"] and six["frag_more"] and six["frag_id"] == 7 and not six["ext_routing"]
    assert only(P.eth((3 << 12 | 0x100 | 9).to_bytes(4, "big"), 0x8847), "mpls")["special_label_name"] == "Implicit NULL"


def test_only_decoders_that_lead_to_a_protocol_run(monkeypatch):
    import pyarrow as pa

    ran = []
    monkeypatch.setattr(core, "chosen", lambda hints, old=core.chosen: (d := old(hints)) and core.Decoder(d.name, d.wants, lambda b, h: (ran.append(d.name), d.parse(b, h))[1]))
    hello = P.eth(P.ip(P.tcp(4000, 443, flags=24, payload=P.record(22, P.client_hello(bytes(32)))), 6))
    query = P.eth(P.ip(P.udp(4000, 53, P.dns_query("a.test")), 17))
    for name, frame, want in (("ipv4", hello, ["ethernet", "ipv4"]), ("tcp", hello, ["ethernet", "ipv4", "tcp"]), ("tls", hello, ["ethernet", "ipv4", "tcp", "tls"]), ("udp", query, ["ethernet", "ipv4", "udp"]), ("arp", query, ["ethernet", "ipv4", "udp"])):
        ran.clear()
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([frame])], ["frame_number", "link_type", "raw_data"])
        rows = next(tables._rows(iter([batch]), name, []))
        assert ran == want and len(rows) == (name in want)
