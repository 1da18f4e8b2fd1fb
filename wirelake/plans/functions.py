"""Queries of the engine's own functions; the checks spell the same meaning out in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions import names
from wirelake.operators.hdr import histograms
from wirelake.plans.lens import run, with_derived
from wirelake.session import table


def _case(n: str, codes: dict[int, str], default: str) -> str:
    rows = ", ".join(f"({k}, '{v}')" for k, v in codes.items())
    return f"CASE WHEN {n} IS NOT NULL THEN coalesce((SELECT v FROM (VALUES {rows}) AS x(k, v) WHERE k = {n}), {default}) END"


#: function -> (column of ``code``, table, text of other codes)
NAMED = {
    "dns_type_name": ("n16", names.DNS_TYPE, "concat('TYPE', {})"), "dns_rcode_name": ("n8", names.DNS_RCODE, "concat('RCODE', {})"), "dns_class_name": ("n8", names.DNS_CLASS, "concat('CLASS', {})"),
    "icmp_type_name": ("n8", names.ICMP_TYPE, "concat('Type ', {})"), "icmpv6_type_name": ("n8", names.ICMPV6_TYPE, "concat('Type ', {})"), "ip_proto_name": ("n8", names.IP_PROTO, "concat('Proto ', {})"),
    "ethertype_name": ("n16", names.ETHERTYPE, "printf('0x%04X', {})"), "bgp_message_type_name": ("n8", names.BGP_MESSAGE, "concat('Unknown (', {}, ')')"), "bgp_origin_name": ("n8", names.BGP_ORIGIN, "concat('Unknown (', {}, ')')"),
    "ospf_packet_type_name": ("n8", names.OSPF_PACKET, "concat('Unknown (', {}, ')')"), "ospf_lsa_type_name": ("n8", names.OSPF_LSA, "concat('Unknown (', {}, ')')"),
    "gtp_message_type_name": ("n8", names.GTP_MESSAGE, "concat('Unknown (', {}, ')')"), "ntp_mode_name": ("n8", names.NTP_MODE, "concat('Unknown (', {}, ')')"),
    "ntp_stratum_name": ("n8", names.NTP_STRATUM, "CASE WHEN {} BETWEEN 2 AND 15 THEN concat('Secondary (stratum ', {}, ')') ELSE concat('Reserved (', {}, ')') END"),
    "tls_version_name": ("n16", names.TLS_VERSION, "CASE WHEN ({} & 3855) = 2570 THEN 'GREASE' ELSE printf('Unknown (0x%04x)', {}) END"), "tls_record_type_name": ("n8", names.TLS_RECORD, "concat('Unknown (', {}, ')')"),
}

_QUAD = "concat({0} >> 24, '.', ({0} >> 16) & 255, '.', ({0} >> 8) & 255, '.', {0} & 255)"
_MAC = "concat_ws(':', substr(h, 1, 2), substr(h, 3, 2), substr(h, 5, 2), substr(h, 7, 2), substr(h, 9, 2), substr(h, 11, 2))"
_FLAGS = "concat_ws(',', " + ", ".join(f"CASE WHEN (f & {1 << i}) <> 0 THEN '{n}' END" for i, n in enumerate(names.TCP_FLAGS)) + ")"


def _nested(codes: dict[int, tuple[dict[int, str], str]], fixed: str = "") -> str:
    rows = ", ".join(f"({t}, {c}, '{v}')" for t, (own, _) in codes.items() for c, v in own.items())
    kinds = " ".join(f"WHEN {t} THEN concat('{other} (code ', c, ')')" for t, (_, other) in codes.items())
    return f"coalesce((SELECT v FROM (VALUES {rows}) AS x(a, b, v) WHERE a = t AND b = c), CASE t {kinds} {fixed} ELSE CASE WHEN c = 0 THEN 'No Code' ELSE concat('Code ', c) END END)"


#: name -> (Spark SQL, DuckDB SQL)
PAIRS = {
    "ip4_parse": (
        "SELECT connection_id, ip4(client_ip) AS client, ip4(server_ip) AS server, ip4(concat(client_ip, '9999')) AS bad, ip4(concat('0', server_ip)) AS zero FROM tcp_connections",
        "SELECT connection_id, " + ", ".join("+".join(f"CAST(split_part({c}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)) + f" AS {a}" for c, a in (("client_ip", "client"), ("server_ip", "server"))) + ", CAST(NULL AS BIGINT) AS bad, CAST(NULL AS BIGINT) AS zero FROM tcp_connections",
    ),
    "ip4_format": ("SELECT frame_number, ip4_to_string(src_ip) AS src, ip4_to_string(dst_ip) AS dst FROM ipv4", f"SELECT frame_number, CASE WHEN src_ip IS NOT NULL THEN {_QUAD.format('src_ip')} END AS src, CASE WHEN dst_ip IS NOT NULL THEN {_QUAD.format('dst_ip')} END AS dst FROM ipv4"),
    "cidr_v4": (
        "SELECT frame_number, ip_in_cidr(src_ip, '10.64.0.0/10') AS a, ip_in_cidr(dst_ip, '203.0.113.77/26') AS b, ip_in_cidr(src_ip, '0.0.0.0/0') AS every, ip_in_cidr(src_ip, '10.0.0.0/33') AS bad, ip_in_cidr(src_ip, '10.0.0.0') AS none FROM ipv4",
        "SELECT frame_number, src_ip >> 22 = 171966464 >> 22 AS a, dst_ip >> 6 = 3405803853 >> 6 AS b, CASE WHEN src_ip IS NOT NULL THEN true END AS every, CAST(NULL AS BOOLEAN) AS bad, CAST(NULL AS BOOLEAN) AS none FROM ipv4",
    ),
    "private_multicast_loopback": (
        "SELECT event_id, is_private_ip(address) AS own, is_multicast_ip(address) AS many, is_loopback_ip(address) AS self FROM code",
        "SELECT event_id, address >> 24 = 10 OR address >> 20 = 2753 OR address >> 16 = 49320 AS own, address >> 28 = 14 AS many, address >> 24 = 127 AS self FROM code",
    ),
    "mac_parse_format": (
        "SELECT frame_number, mac_to_string(substring(raw_data, 1, 6)) AS dst, hex(mac(mac_to_string(substring(raw_data, 7, 6)))) AS src, hex(mac(replace(mac_to_string(substring(raw_data, 1, 6)), ':', '-'))) AS dashed, mac('00:11:22:33:44') IS NULL AS short FROM frames WHERE length(raw_data) >= 12",
        f"SELECT frame_number, lower({_MAC.replace('h,', 'hex(raw_data),')}) AS dst, substr(hex(raw_data), 13, 12) AS src, substr(hex(raw_data), 1, 12) AS dashed, true AS short FROM frames WHERE octet_length(raw_data) >= 12",
    ),
    "mac_class": (
        "SELECT frame_number, mac_is_broadcast(m) AS every, mac_is_multicast(m) AS many, mac_is_local(m) AS own FROM (SELECT frame_number, substring(raw_data, 1, 6) AS m FROM frames WHERE length(raw_data) >= 6) x",
        "SELECT frame_number, h = 'FFFFFFFFFFFF' AS every, (CAST('0x' || substr(h, 1, 2) AS INT) & 1) = 1 AS many, (CAST('0x' || substr(h, 1, 2) AS INT) & 2) = 2 AS own FROM (SELECT frame_number, substr(hex(raw_data), 1, 12) AS h FROM frames WHERE octet_length(raw_data) >= 6) x",
    ),
    "ip6_class": (
        "SELECT frame_number, is_link_local_ip6(a) AS near, is_multicast_ip6(a) AS many, ip6_in_cidr(a, '2001:db8::/32') AS documented, ip6_in_cidr(a, '2001:db8::/129') AS bad FROM query_six",
        "SELECT frame_number, substr(hex(a), 1, 2) = 'FE' AND substr(hex(a), 3, 1) IN ('8', '9', 'A', 'B') AS near, substr(hex(a), 1, 2) = 'FF' AS many, substr(hex(a), 1, 8) = '20010DB8' AS documented, CAST(NULL AS BOOLEAN) AS bad FROM query_six",
    ),
    "tcp_flags_str": ("SELECT frame_number, tcp_flags_str(flags) AS names FROM tcp", f"SELECT frame_number, {_FLAGS.replace('(f &', '(flags &')} AS names FROM tcp"),
    "has_tcp_flag": (
        "SELECT frame_number, has_tcp_flag(flags, 'syn') AS syn, has_tcp_flag(flags, 'ACK') AS ack, has_tcp_flag(flags, 'NS') AS ns, has_tcp_flag(flags, 'nope') AS other FROM tcp",
        "SELECT frame_number, (flags & 2) <> 0 AS syn, (flags & 16) <> 0 AS ack, (flags & 256) <> 0 AS ns, false AS other FROM tcp",
    ),
    "icmp_code_name": ("SELECT DISTINCT t, c, icmp_code_name(t, c) AS name FROM code", f"SELECT DISTINCT t, c, {_nested(names.ICMP_CODE)} AS name FROM code"),
    "icmpv6_code_name": (
        "SELECT DISTINCT t, c, icmpv6_code_name(t, c) AS name FROM (SELECT CASE WHEN t > 10 THEN t + 127 ELSE t END AS t, c FROM code) x",
        f"SELECT DISTINCT t, c, {_nested(names.ICMPV6_CODE, chr(10) + 'WHEN 2 THEN ' + chr(39) + 'Packet Too Big' + chr(39))} AS name FROM (SELECT CASE WHEN t > 10 THEN t + 127 ELSE t END AS t, c FROM code) x",
    ),
    "format_lists": (
        "SELECT frame_number, format_ip4_list(answer_ip4s) AS four, size(format_ip6_list(answer_ip6s)) AS six, element_at(format_mac_list(array(substring(cast(query_name AS BINARY), 1, 6))), 1) AS m FROM (SELECT DISTINCT * FROM dns) q WHERE length(query_name) >= 6",
        f"SELECT frame_number, list_transform(answer_ip4s, lambda x: {_QUAD.format('x')}) AS four, CAST(len(answer_ip6s) AS INT) AS six, lower({_MAC.replace('h,', 'hex(encode(query_name)),')}) AS m FROM (SELECT DISTINCT * FROM dns) q WHERE length(query_name) >= 6",
    ),
    "hex_unhex": (
        "SELECT frame_number, pcap_hex(raw_data) AS h, hex(pcap_unhex(concat(' 0x', hex(raw_data)))) AS back, pcap_unhex('abc') IS NULL AS odd, pcap_unhex('zz') IS NULL AS bad FROM frames",
        "SELECT frame_number, lower(hex(raw_data)) AS h, hex(raw_data) AS back, true AS odd, true AS bad FROM frames",
    ),
    "strftime": ("SELECT frame_number, strftime('%Y-%m-%d %H:%M:%S', ts) AS t, strftime('%d/%m/%y %j', ts) AS d FROM pkt", "SELECT frame_number, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%d/%m/%y %j') AS d FROM pkt"),
    "datetime": ("SELECT frame_number, datetime(ts) AS t FROM pkt", "SELECT frame_number, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t FROM pkt"),
    "date_text": ("SELECT frame_number, fmt_date(ts) AS t FROM pkt", "SELECT frame_number, strftime(ts, '%Y-%m-%d') AS t FROM pkt"),
    "time_text": ("SELECT frame_number, fmt_time(ts) AS t FROM pkt", "SELECT frame_number, strftime(ts, '%H:%M:%S.%f') AS t FROM pkt"),
    "epoch": ("SELECT frame_number, epoch(ts) AS t FROM pkt", "SELECT frame_number, epoch_us(ts) / 1e6 AS t FROM pkt"),
    "epoch_ms": ("SELECT frame_number, epoch_ms(ts) AS t FROM pkt", "SELECT frame_number, epoch_us(ts) // 1000 AS t FROM pkt"),
}

for _n in ("ip6_class",):
    PAIRS[_n] = (
        PAIRS[_n][0].replace("query_six", "(SELECT frame_number, explode(answer_ip6s) AS a FROM dns) q"),
        PAIRS[_n][1].replace("query_six", "(SELECT frame_number, unnest(answer_ip6s) AS a FROM dns) q"),
    )
for _f, (_col, _codes, _other) in NAMED.items():
    PAIRS[_f] = (f"SELECT DISTINCT {_col} AS n, {_f}({_col}) AS name FROM code", f"SELECT DISTINCT {_col} AS n, {_case(_col, _codes, _other.format(*[_col] * 3))} AS name FROM code")

_BUCKETS = """b AS (SELECT protocol, CASE WHEN v < 256 THEN v ELSE (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) END AS low, count(*) AS n FROM (SELECT protocol, CAST(total_length AS BIGINT) * total_length AS v FROM ipv4 WHERE protocol IS NOT NULL AND total_length IS NOT NULL) x GROUP BY ALL),
    e AS (SELECT *, CASE WHEN low < 256 THEN low ELSE low + (1::BIGINT << (length(bin(low)) - 8)) - 1 END AS high, CASE WHEN low < 256 THEN low ELSE low + (1::BIGINT << (length(bin(low)) - 9)) END AS mid,
        sum(n) OVER (PARTITION BY protocol ORDER BY low) AS upto, sum(n) OVER (PARTITION BY protocol) AS total FROM b)"""
HDR_ORACLES = {
    "hdr_sql": f"WITH {_BUCKETS} SELECT protocol, CAST(min(high) FILTER (WHERE upto >= ceil(0.95 * total)) AS DOUBLE) AS p95, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY protocol",
    "hdr_percentiles": f"""WITH {_BUCKETS} SELECT protocol, CAST(min(high) FILTER (WHERE upto >= ceil(0.5 * total)) AS DOUBLE) AS p50, CAST(min(high) FILTER (WHERE upto >= ceil(0.95 * total)) AS DOUBLE) AS p95,
        CAST(min(high) FILTER (WHERE upto >= ceil(0.99 * total)) AS DOUBLE) AS p99, CAST(min(low) AS DOUBLE) AS p0, CAST(max(high) AS DOUBLE) AS p100 FROM e GROUP BY protocol""",
    "hdr_stats": f"""WITH {_BUCKETS}, m AS (SELECT protocol, sum(n * CAST(mid AS DOUBLE)) / sum(n) AS mean FROM e GROUP BY protocol)
        SELECT protocol, CAST(sum(n) AS BIGINT) AS n, min(low) AS low, max(high) AS high, round(any_value(mean), 4) AS mean, round(sqrt(sum(n * (mid - mean) * (mid - mean)) / sum(n)), 2) AS stdev FROM e JOIN m USING (protocol) GROUP BY protocol""",
}


def _squares(spark: SparkSession, d: str) -> DataFrame:
    from wirelake.functions.catalogue import register

    register(spark)
    rows = table(spark, d, "ipv4").where("protocol IS NOT NULL AND total_length IS NOT NULL").select("protocol", (F.col("total_length").cast("long") * F.col("total_length")).alias("v"))
    return histograms(rows, ["protocol"], "v")


def hdr_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _squares(spark, d).selectExpr("protocol", "hdr_percentile(h, 0.5) AS p50", "hdr_percentile(h, 95) AS p95", "hdr_value_at_quantile(h, 0.99) AS p99", "hdr_percentile(h, 0) AS p0", "hdr_percentile(h, 1.0) AS p100")


def hdr_stats(spark: SparkSession, d: str) -> DataFrame:
    return _squares(spark, d).selectExpr("protocol", "hdr_count(h) AS n", "hdr_min(h) AS low", "hdr_max(h) AS high", "round(hdr_mean(h), 4) AS mean", "round(hdr_stdev(h), 2) AS stdev")


def fn_ip6_text(spark: SparkSession, d: str) -> DataFrame:
    """IPv6 answers as text and back."""
    from wirelake.functions.catalogue import register

    register(spark)
    rows = table(spark, d, "dns").select("frame_number", F.explode("answer_ip6s").alias("a")).selectExpr("frame_number", "a", "ip6_to_string(a) AS text")
    return rows.selectExpr("frame_number", "text", "ip6(text) = a AS same")


def capture_time(spark: SparkSession, d: str) -> DataFrame:
    """start_time, end_time and relative_time of the directory's capture."""
    from wirelake.functions.catalogue import register_capture_time

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = table(spark, d, "frames").where("ts >= TIMESTAMP_NTZ '1971-01-01 00:00:00'").agg(F.min(us), F.max(us)).first()
    register_capture_time(spark, low, high)
    return run(spark, d, "SELECT frame_number, relative_time(ts) AS rel, ts = start_time() AS is_first, ts = end_time() AS is_last FROM pkt")


def _query(sql: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return run(spark, d, sql)

    return query


def hdr_sql(spark: SparkSession, d: str) -> DataFrame:
    """The histogram as an aggregate function of SQL."""
    return run(spark, d, "SELECT protocol, hdr_percentile(h, 0.95) AS p95, hdr_count(h) AS n FROM (SELECT protocol, hdr_histogram(cast(total_length AS BIGINT) * total_length) AS h FROM ipv4 WHERE protocol IS NOT NULL AND total_length IS NOT NULL GROUP BY protocol) x")


QUERIES = {f"fn_{n}": _query(sql) for n, (sql, _) in PAIRS.items()} | {"hdr_percentiles": hdr_percentiles, "hdr_stats": hdr_stats, "hdr_sql": hdr_sql, "fn_ip6_text": fn_ip6_text, "fn_capture_time": capture_time}
ORACLES = {f"fn_{n}": with_derived(sql) for n, (_, sql) in PAIRS.items()} | HDR_ORACLES | {
    "fn_capture_time": with_derived("SELECT frame_number, (epoch_us(ts) - epoch_us((SELECT min(ts) FROM pkt))) / 1e6 AS rel, ts = (SELECT min(ts) FROM pkt) AS is_first, ts = (SELECT max(ts) FROM pkt) AS is_last FROM pkt")
}
