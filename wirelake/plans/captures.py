"""Queries through the packet side of the engine: filters, decoders and stream states.

Filters run over the driver's tables under the names that filters use; decoders run over the bytes in
``frames``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.decode import tables
from wirelake.decode.outer import outer_headers
from wirelake.functions.catalogue import register
from wirelake.plans import filters
from wirelake.plans.lens import DERIVED, with_derived
from wirelake.session import table

#: name -> (filter, the same in SQL over p (packets), i (ipv4), t (tcp), u (udp))
FILTERS = {
    "bpf_proto": ("tcp", "t.frame_number IS NOT NULL"),
    "bpf_host": ("host 203.0.113.42", "i.src_ip = 3405803818 OR i.dst_ip = 3405803818"),
    "bpf_src_host": ("src host 203.0.113.42", "i.src_ip = 3405803818"),
    "bpf_port": ("port 443", "443 IN (t.src_port, t.dst_port) OR 443 IN (u.src_port, u.dst_port)"),
    "bpf_portrange": ("tcp dst portrange 22-100", "t.dst_port BETWEEN 22 AND 100"),
    "bpf_net": ("net 10.64.0.0/10", "i.src_ip >> 22 = 171966464 >> 22 OR i.dst_ip >> 22 = 171966464 >> 22"),
    "bpf_boolean": ("(tcp or udp) and !(port 443 || port 53) && not net 10.64.0.0/10", "(t.frame_number IS NOT NULL OR u.frame_number IS NOT NULL) AND NOT (coalesce(443 IN (t.src_port, t.dst_port) OR 53 IN (t.src_port, t.dst_port), false) OR coalesce(443 IN (u.src_port, u.dst_port) OR 53 IN (u.src_port, u.dst_port), false)) AND NOT coalesce(i.src_ip >> 22 = 171966464 >> 22 OR i.dst_ip >> 22 = 171966464 >> 22, false)"),
    "bpf_proto_number": ("proto 17", "i.protocol = 17"),
}


def _filter(text: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        session = spark.newSession()  # the names of the filter's tables stay apart from other queries
        register(session)
        for t in ("frames", "ipv4", "segments", "dns", "tls"):
            session.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
        found = {n: session.sql(DERIVED[n]) for n in ("pkt", "tcp", "udp")}
        found["pkt"].createOrReplaceTempView("frames")
        found["tcp"].createOrReplaceTempView("tcp")
        found["udp"].createOrReplaceTempView("udp")
        return filters.matching_frames(session, text)

    return query


def _filter_sql(condition: str) -> str:
    return with_derived(f"SELECT DISTINCT p.frame_number FROM pkt p LEFT JOIN ipv4 i ON i.frame_number = p.frame_number LEFT JOIN tcp t ON t.frame_number = p.frame_number LEFT JOIN udp u ON u.frame_number = p.frame_number WHERE {condition}")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frames").select("frame_number", F.col("ts").alias("timestamp"), "length", "original_length", "link_type", "raw_data")


def _decoded(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return tables.table(_frames(spark, d), name)

    return query


def cap_decode(spark: SparkSession, d: str) -> DataFrame:
    """Every layer of every frame: rows by protocol, depth and tunnel."""
    return tables.layers(_frames(spark, d)).groupBy("proto", F.col("encap_depth").alias("depth")).agg(F.count("*").alias("n"))


def cap_ipv4_agrees(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose outer IPv4 header, decoded here, is the one in the table ``ipv4``."""
    own = tables.table(_frames(spark, d), "ipv4").where("encap_depth = 0").select("frame_number", "src_ip", "dst_ip", "ttl", "protocol", "total_length").distinct()
    given = table(spark, d, "ipv4").where("encap_depth = 0").select("frame_number", "src_ip", "dst_ip", "ttl", "protocol", "total_length").distinct()
    return own.join(given, own.columns).groupBy("protocol").agg(F.count("*").alias("n"))


def cap_headers(spark: SparkSession, d: str) -> DataFrame:
    """Link and outer network header of every frame, decoded from its bytes."""
    register(spark)
    frames = _frames(spark, d)
    link = tables.table(frames, "ethernet").where("encap_depth = 0").selectExpr("frame_number AS n", "hex(src_mac) AS src_mac", "hex(dst_mac) AS dst_mac", "ethertype")
    net = tables.table(frames, "ipv4").where("encap_depth = 0 AND version IS NOT NULL").select("frame_number", "ihl", "total_length", "identification", "dont_fragment", "fragment_offset", "ttl", "protocol", "checksum", "src_ip", "dst_ip")
    return link.join(net, F.col("n") == F.col("frame_number")).drop("n").distinct()


def cap_outer(spark: SparkSession, d: str) -> DataFrame:
    """Outer headers of every frame by expressions alone."""
    return outer_headers(_frames(spark, d)).where("src_ip IS NOT NULL").select("frame_number", "ethertype", "src_ip", "dst_ip", "ttl", "protocol", "total_length", "src_port", "dst_port").distinct()


def _at(i: int, n: int, kind: str = "INT") -> str:
    return f"CAST('0x' || substr(hex(raw_data), {2 * i + 1}, {2 * n}) AS {kind})"


QUERIES = {n: _filter(text) for n, (text, _) in FILTERS.items()} | {"cap_ethernet": _decoded("ethernet"), "cap_ipv4": _decoded("ipv4"), "cap_arp": _decoded("arp"), "cap_udp": _decoded("udp"), "cap_icmp": _decoded("icmp"), "cap_decode": cap_decode, "cap_headers": cap_headers, "cap_outer": cap_outer, "cap_ipv4_agrees": cap_ipv4_agrees}
_PORTS = f"({_at(20, 2)} & 8191) = 0 AND (({_at(23, 1)} = 17 AND octet_length(raw_data) >= 42) OR ({_at(23, 1)} = 6 AND octet_length(raw_data) >= 54))"
ORACLES = {n: _filter_sql(sql) for n, (_, sql) in FILTERS.items()} | {
    "cap_headers": f"""SELECT DISTINCT frame_number, substr(hex(raw_data), 13, 12) AS src_mac, substr(hex(raw_data), 1, 12) AS dst_mac, {_at(12, 2)} AS ethertype, {_at(14, 1)} & 15 AS ihl, {_at(16, 2)} AS total_length,
        {_at(18, 2)} AS identification, ({_at(20, 2)} & 16384) <> 0 AS dont_fragment, {_at(20, 2)} & 8191 AS fragment_offset, {_at(22, 1)} AS ttl, {_at(23, 1)} AS protocol, {_at(24, 2)} AS checksum,
        {_at(26, 4, "BIGINT")} AS src_ip, {_at(30, 4, "BIGINT")} AS dst_ip
        FROM frames WHERE octet_length(raw_data) >= 34 AND {_at(12, 2)} = 2048 AND {_at(14, 1)} >> 4 = 4 AND {_at(14, 1)} & 15 >= 5 AND octet_length(raw_data) >= 14 + 4 * ({_at(14, 1)} & 15)""",
    "cap_outer": f"""SELECT DISTINCT frame_number, {_at(12, 2)} AS ethertype, {_at(26, 4, "BIGINT")} AS src_ip, {_at(30, 4, "BIGINT")} AS dst_ip, CAST({_at(22, 1)} AS SMALLINT) AS ttl, CAST({_at(23, 1)} AS SMALLINT) AS protocol,
        {_at(16, 2)} AS total_length, CASE WHEN {_PORTS} THEN {_at(34, 2)} END AS src_port, CASE WHEN {_PORTS} THEN {_at(36, 2)} END AS dst_port
        FROM frames WHERE octet_length(raw_data) >= 34 AND {_at(12, 2)} = 2048 AND {_at(14, 1)} = 69""",
}
