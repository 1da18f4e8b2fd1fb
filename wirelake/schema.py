"""Schemas of all tables. Unsigned types are widened one step, so every value fits.

Protocol tables begin with ``frame_number`` and end with the encapsulation columns: depth 0 is the
outermost layer, ``tunnel_type`` and ``tunnel_id`` name the tunnel the layer is in.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

_KINDS = {
    "u8": (T.ShortType(), pa.int16()), "u16": (T.IntegerType(), pa.int32()), "u32": (T.LongType(), pa.int64()), "u64": (T.LongType(), pa.int64()), "i8": (T.ByteType(), pa.int8()),
    "i16": (T.ShortType(), pa.int16()), "i32": (T.IntegerType(), pa.int32()), "i64": (T.LongType(), pa.int64()), "f64": (T.DoubleType(), pa.float64()), "bool": (T.BooleanType(), pa.bool_()),
    "str": (T.StringType(), pa.string()), "bin": (T.BinaryType(), pa.binary()), "ts": (T.TimestampNTZType(), pa.timestamp("us")), "[u16]": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "[u32]": (T.ArrayType(T.LongType()), pa.list_(pa.int64())), "[str]": (T.ArrayType(T.StringType()), pa.list_(pa.string())), "[bin]": (T.ArrayType(T.BinaryType()), pa.list_(pa.binary())),
}

# The columns of every protocol table, without frame_number and encapsulation.
PROTOCOLS = {
    "ethernet": "src_mac bin, dst_mac bin, ethertype u16",
    "linux_sll": "packet_type u16, packet_type_name str, arphrd_type u16, arphrd_name str, addr_len u16, addr bin, protocol u16",
    "arp": "hardware_type u16, protocol_type u16, hardware_size u8, protocol_size u8, operation u16, operation_name str, sender_mac bin, sender_ip u32, target_mac bin, target_ip u32",
    "vlan": "vlan_id u16, priority u8, dei bool, inner_ethertype u16",
    "mpls": "label u32, tc u8, bottom bool, ttl u8, stack_depth u8, labels str",
    "ipv4": "version u8, ihl u8, dscp u8, ecn u8, total_length u16, identification u16, dont_fragment bool, more_fragments bool, fragment_offset u16, ttl u8, protocol u8, checksum u16, src_ip u32, dst_ip u32",
    "ipv6": "version u8, traffic_class u8, flow_label u32, payload_length u16, next_header u8, hop_limit u8, src_ip bin, dst_ip bin",
    "tcp": (
        "src_port u16, dst_port u16, seq u32, ack u32, data_offset u8, flags u16, flag_fin bool, flag_syn bool, flag_rst bool, flag_psh bool, flag_ack bool, flag_urg bool, window u16, checksum u16, urgent_ptr u16, "
        "options_length u8, options str, mss u16, window_scale u8, sack_permitted bool, sack_left_edges [u32], sack_right_edges [u32], ts_val u32, ts_ecr u32"
    ),
    "udp": "src_port u16, dst_port u16, length u16, checksum u16",
    "icmp": "type u8, code u8, checksum u16, type_name str, identifier u16, sequence u16, next_hop_mtu u16, gateway u32",
    "icmpv6": (
        "type u8, code u8, checksum u16, type_name str, echo_id u16, echo_seq u16, mtu u32, pointer u32, ndp_target_address bin, ndp_cur_hop_limit u8, ndp_managed_flag bool, ndp_other_flag bool, ndp_router_lifetime u16, "
        "ndp_reachable_time u32, ndp_retrans_timer u32, ndp_router_flag bool, ndp_solicited_flag bool, ndp_override_flag bool, ndp_source_mac bin, ndp_target_mac bin, ndp_prefix bin, ndp_prefix_length u8, "
        "mld_max_response_delay u16, mld_multicast_address bin, mld_num_group_records u16"
    ),
    "gre": "checksum_present bool, key_present bool, sequence_present bool, version u8, protocol u16, checksum u16, key u32, sequence u32",
    "vxlan": "flags u8, vni u32",
    "gtp": "version u8, protocol_type u8, message_type u8, length u16, teid u32, sequence u16",
    "ipsec": "protocol str, spi u32, sequence u32, ah_next_header u8, ah_icv_length u8",
    "bgp": "message_type u8, message_type_name str, length u16, version u8, my_as u16, hold_time u16, bgp_id str, withdrawn_routes_len u16, path_attr_len u16",
    "ospf": "version u8, message_type u8, message_type_name str, length u16, router_id str, area_id str, auth_type u16, hello_interval u16, dead_interval u32, designated_router str, backup_dr str",
    "dns": (
        "transaction_id u16, is_query bool, opcode u8, is_authoritative bool, is_truncated bool, recursion_desired bool, recursion_available bool, response_code u8, query_count u16, answer_count u16, authority_count u16, "
        "additional_count u16, query_name str, query_type u16, query_class u16, answer_ip4s [u32], answer_ip6s [bin], answer_cnames [str], answer_types [u16], answer_ttls [u32], has_edns bool, edns_udp_size u16"
    ),
    "dhcp": "op u8, htype u8, hlen u8, hops u8, xid u32, secs u16, flags u16, ciaddr u32, yiaddr u32, siaddr u32, giaddr u32, chaddr bin, message_type u8, server_id u32, lease_time u32, subnet_mask u32, router u32, dns_servers str",
    "ntp": "version u8, mode u8, leap_indicator u8, stratum u8, poll i8, precision i8, root_delay f64, root_dispersion f64, reference_id str, reference_ts f64, origin_ts f64, receive_ts f64, transmit_ts f64",
    "http": (
        "is_request bool, headers_complete bool, method str, uri str, version str, status_code u16, status_text str, body_length u64, host str, content_type str, content_length u64, user_agent str, server str, transfer_encoding str, "
        "connection str, cookie str, set_cookie str, referer str, accept str, accept_encoding str, accept_language str, cache_control str, authorization str, location str, x_forwarded_for str, x_real_ip str"
    ),
    "http2": (
        "frame_type str, stream_id u32, flags u8, length u32, method str, path str, authority str, scheme str, status u16, request_headers str, response_headers str, content_type str, content_length u64, user_agent str, data_length u64, "
        "end_stream bool, end_headers bool, padding_length u8, settings str, ack bool, header_table_size u32, max_concurrent_streams u32, initial_window_size u32, max_frame_size u32, error_code u32, error_name str, last_stream_id u32, "
        "debug_data str, window_increment u32, priority_exclusive bool, priority_dependency u32, priority_weight u8, promised_stream_id u32, stream_state str"
    ),
    "tls": (
        "record_type u8, record_version u16, version str, handshake_type u8, handshake_version u16, client_random bin, server_random bin, session_id bin, session_id_length u8, cipher_suites str, cipher_suite_count u16, selected_cipher str, "
        "selected_cipher_id u16, compression_methods str, selected_compression u8, sni str, alpn str, supported_versions str, signature_algorithms str, supported_groups str, ec_point_formats str, extensions_length u16, extension_types str, "
        "alert_level u8, alert_description u8, alert_description_str str, is_heartbeat bool, heartbeat_type u8, is_change_cipher_spec bool, has_app_data bool, app_data_length u32, ja3 str, ja3_hash str, ja3s str, ja3s_hash str, certificate_count u16"
    ),
    "ssh": (
        "protocol_version str, software_version str, comments str, packet_length u32, padding_length u8, msg_type u8, msg_type_name str, encrypted bool, kex_algorithms str, host_key_algorithms str, encryption_algorithms str, "
        "mac_algorithms str, compression_algorithms str, auth_username str, auth_service str, auth_method str, channel_type str, channel_id u32"
    ),
    "quic": "header_form str, long_packet_type str, version u32, version_name str, dcid_length u8, dcid str, scid_length u8, scid str, token_length u32, packet_length u32, spin_bit bool, key_phase bool, sni str",
    "netlink": "msg_len u32, msg_type u16, msg_flags u16, msg_seq u32, msg_pid u32, msg_type_name str, is_request bool, is_multipart bool, is_ack bool, is_echo bool, family u8, family_name str",
    "rtnetlink": (
        "msg_type u16, msg_type_name str, link_index u32, link_type u16, link_flags u32, if_name str, mtu u32, hw_addr bin, addr_family u8, addr_family_name str, prefix_len u8, addr_index u32, address str, local_addr str, route_family u8, "
        "dst_prefix_len u8, src_prefix_len u8, route_table u8, route_protocol u8, route_scope u8, route_type u8, destination str, gateway str, oif_index u32"
    ),
}
# Further fields that the extended tables show between the own columns and the encapsulation.
EXTENDED = {
    "ipv6": "ext_hop_by_hop bool, ext_routing bool, ext_fragment bool, ext_destination bool, frag_offset u16, frag_more bool, frag_id u32, routing_type u8, segments_left u8",
    "gre": "version_name str, header_length u8",
    "vxlan": "i_flag_valid bool, flags_valid bool, inner_frame_length u32",
    "bgp": (
        "my_as_4byte u32, capabilities str, withdrawn_routes str, withdrawn_count u16, origin u8, origin_name str, as_path str, as_path_length u16, next_hop str, med u32, local_pref u32, atomic_aggregate bool, aggregator_as u32, "
        "aggregator_ip str, nlri str, nlri_count u16, error_code u8, error_code_name str, error_subcode u8, afi u16, safi u8"
    ),
    "ospf": (
        "neighbor_count u16, dd_interface_mtu u16, dd_options u8, dd_flags u8, dd_sequence u32, dd_lsa_count u16, lsu_lsa_count u32, lsa_age u16, lsa_type u8, lsa_type_name str, lsa_id str, lsa_advertising_router str, "
        "lsa_sequence u32, lsa_ack_count u16"
    ),
    "mpls": "is_reserved_label bool, special_label_name str",
    "gtp": "npdu u8, extension_headers str, extension_header_count u8, piggyback bool, teid_present bool",
}
# The tables that streams fill.
STREAMS = {
    "tcp_connections": (
        "connection_id i64, client_ip str, server_ip str, client_port i32, server_port i32, state str, start_time ts, end_time ts, duration_us i64, first_frame i64, last_frame i64, packets_to_server i32, packets_to_client i32, "
        "bytes_to_server i64, bytes_to_client i64, is_complete bool"
    ),
    "tcp_streams": "connection_id i64, direction str, payload bin, payload_length i64, is_complete bool, gap_count i32, segment_count i32, retransmit_count i32, out_of_order_count i32",
    "http_messages": (
        "connection_id i64, message_id i32, direction str, is_request bool, first_frame i64, method str, uri str, http_version str, status_code i16, status_text str, host str, content_type str, content_length i64, user_agent str, server str"
    ),
    "tls_sessions": "connection_id i64, version str, cipher_suite str, cipher_suite_id i32, sni str, alpn str, is_decrypted bool, first_frame i64",
}
_FRAMES = "frame_number u64, timestamp ts, length u32, original_length u32, link_type u16, raw_data bin"
_ENCAP = "encap_depth u8, tunnel_type str, tunnel_id u64"


def _fields(text: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in text.split(", ")]


def fields(name: str, extended: bool = False) -> list[tuple[str, str]]:
    """(column, kind) of a table."""
    if name == "frames":
        return _fields(_FRAMES)
    if name in STREAMS:
        return _fields(STREAMS[name])
    return [("frame_number", "u64"), *own_fields(name, extended), *_fields(_ENCAP)]


def own_fields(name: str, extended: bool = False) -> list[tuple[str, str]]:
    """(column, kind) of a protocol's own columns."""
    return _fields(PROTOCOLS[name]) + (_fields(EXTENDED[name]) if extended and name in EXTENDED else [])


def spark_schema(name: str, extended: bool = False) -> T.StructType:
    solid = {"frame_number", "encap_depth"}
    return T.StructType([T.StructField(c, _KINDS[k][0], c not in solid) for c, k in fields(name, extended)])


def arrow_schema(name: str, extended: bool = False) -> pa.Schema:
    return pa.schema([pa.field(c, _KINDS[k][1]) for c, k in fields(name, extended)])


TABLES = ("frames", *PROTOCOLS)
