from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from wirelake.operators import dense, hdr, sessions
from wirelake.operators.capture import once, once_without_key, plain_name, week_of
from wirelake.functions import catalogue
from wirelake.plans import filters
from pyspark.sql import functions as F


def brute_dense(rows):
    out = {}
    for g, k, v, t in rows:
        n, top, tie = out.get((g, k), (0, None, None))
        if v is not None and (top is None or v > top or (v == top and t is not None and (tie is None or t < tie))):
            top, tie = v, t
        out[g, k] = (n + 1, top, tie)
    return {(g, k, *x) for (g, k), x in out.items()}


@pytest.mark.parametrize("flush,rows_held", [(7, 50), (500_000, 100_000)])
def test_dense_extremes(spark, flush, rows_held):
    rnd = random.Random(3)
    # one key holds a third of the rows; NULLs in every column, ties, repeated rows
    rows = [(rnd.choice([1, 2, None]), 5 if rnd.random() < 0.33 else rnd.choice([None, *range(40)]), rnd.choice([None, 1, 2, 3]), rnd.choice([None, *range(9)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "grp long, k long, v int, t long").withColumns({"n": F.lit(1), "block": F.lit("x"), "group": F.lit(2), "__key": F.lit(0)})
    got = {tuple(r) for r in dense.dense_extremes(df, "grp", "k", "v", "t", flush_keys=flush, hold_rows=rows_held).collect()}
    assert got == brute_dense(rows)
    assert dense.dense_extremes(df.limit(0), "grp", "k", "v", "t").count() == 0


def brute_sessions(rows, gap):
    by, out = {}, set()
    for e, t, n in rows:
        if e is not None and t is not None:
            by.setdefault(e, []).append((t, n))
    for e, ts in by.items():
        ts.sort()
        start, last, total = ts[0][0], ts[0][0], 0
        for t, n in ts:
            if t - last > gap:
                out.add((e, start, last, total))
                start, total = t, 0
            last, total = t, total + n
        out.add((e, start, last, total))
    return out


@pytest.mark.parametrize("gap,chunk", [(10, 11), (10, 50), (10, 1000), (300, 5)])
def test_pair_sessions(spark, gap, chunk):
    rnd = random.Random(gap + chunk)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 3, 4]), rnd.choice([None, *range(-300, 900, rnd.choice([1, 3, 5]))]), 1) for _ in range(500)]
    rows += [(9, 0, 1), (9, gap, 1), (9, 2 * gap + 1, 1), (9, 2 * gap + 1, 1)]
    df = spark.createDataFrame(rows, "e long, t long, w long").withColumn("__c", F.lit(1)).withColumn("start_us", F.lit("x"))
    got = {tuple(r) for r in sessions.pair_sessions(df, ["e"], "t", gap, chunk).collect()}
    assert got == brute_sessions(rows, gap)
    weighted = sessions.pair_sessions(spark.createDataFrame([(1, 5, 3), (1, 6, 4)], "e long, t long, w long"), ["e"], "t", gap, chunk, weight="w").collect()
    assert [tuple(r) for r in weighted] == [(1, 5, 6, 7)]
    assert sessions.pair_sessions(df.limit(0), ["e"], "t", gap, chunk).count() == 0


def test_once_and_names(spark):
    rows = [(1, None, "a"), (1, None, "a"), (1, "a", None), (2, "b", "b"), (None, "b", "b"), (None, "b", "b")]
    df = spark.createDataFrame(rows, "k long, x string, __row string")
    assert once(df, "k", x=F.col("x")).count() == 3 and once_without_key(df, "k", x=F.col("x")).count() == 1
    names = spark.createDataFrame([("A.b..",), (".",), ("",), (None,)], "n string").select(plain_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["a.b", None, None, None]
    days = spark.range(-20, 40).select(F.col("id"), week_of(F.col("id")).alias("w")).collect()
    assert all((dt.date(1970, 1, 1) + dt.timedelta(days=r.w)).weekday() == 0 and 0 <= r.id - r.w < 7 for r in days)


def test_hdr(spark):
    catalogue.register(spark)
    values = [0, 1, 255, 256, 257, 511, 512, 513, 10**12, 2**48, -5, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "g string, v long")
    h = hdr.histograms(df, ["g"], "v")
    r = h.selectExpr("g", "hdr_count(h) n", "hdr_min(h) lo", "hdr_max(h) hi", "hdr_percentile(h, 0.5) p", "hdr_percentile(h, 0) z", "hdr_mean(h) m", "hdr_stdev(h) s").orderBy("g").collect()
    assert r[0].n == 10 and r[0].lo == 0 and r[0].hi >= 2**48 and r[0].p == 257.0 and r[0].z == 0.0
    assert tuple(r[1])[1:] == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    low = {x: spark.sql(f"SELECT hdr_bucket({x}), hdr_bucket_high(hdr_bucket({x}))").first() for x in (255, 256, 257, 511, 512, 515)}
    assert {x: tuple(v) for x, v in low.items()} == {255: (255, 255), 256: (256, 257), 257: (256, 257), 511: (510, 511), 512: (512, 515), 515: (512, 515)}
    assert df.groupBy("g").agg(catalogue.hdr_histogram("v").alias("h")).where("g = 'a'").first().h == h.where("g = 'a'").first().h
    two = h.unionByName(h).where("g = 'a'")
    assert sum(hdr.merge(two, ["g"]).first().h.values()) == 20
    # the error of a quantile is below one part in 128
    rnd = np.random.default_rng(1).lognormal(10, 2, 5000).astype(int)
    big = hdr.histograms(spark.createDataFrame([(1, int(x)) for x in rnd], "g int, v long"), ["g"], "v").selectExpr("hdr_percentile(h, 0.95)").first()[0]
    exact = sorted(rnd)[int(np.ceil(0.95 * 5000)) - 1]
    assert 0 <= big - exact <= exact / 128


@pytest.mark.parametrize(
    "call,want",
    [
        ("ip4('192.168.1.100')", 3232235876), ("ip4('256.1.1.1')", None), ("ip4('01.1.1.1')", None), ("ip4(NULL)", None), ("ip4('0.0.0.0')", 0), ("ip4('255.255.255.255')", 4294967295),
        ("ip4_to_string(3232235876)", "192.168.1.100"), ("ip_in_cidr(ip4('10.1.2.3'), '10.0.0.0/8')", True), ("ip_in_cidr(ip4('10.1.2.3'), '10.9.9.9/8')", True), ("ip_in_cidr(1, '0.0.0.0/0')", True),
        ("ip_in_cidr(1, '10.0.0.0/33')", None), ("ip_in_cidr(1, '10.0.0.0')", None), ("ip_in_cidr(ip4('1.2.3.4'), '1.2.3.4/32')", True), ("is_private_ip(ip4('172.31.0.1'))", True), ("is_private_ip(ip4('172.32.0.1'))", False),
        ("is_multicast_ip(ip4('239.0.0.1'))", True), ("is_loopback_ip(ip4('127.9.9.9'))", True), ("ip6_to_string(ip6('2001:DB8:0:0::1'))", "2001:db8::1"), ("ip6_to_string(ip6('::ffff:1.2.3.4'))", "::ffff:1.2.3.4"), ("ip6('x')", None),
        ("ip6_in_cidr(ip6('fe80::1'), 'fe80::/10')", True), ("ip6_in_cidr(ip6('fe80::1'), 'fe80::/129')", None), ("ip6_in_cidr(ip6('2001:db8::1'), '::/0')", True), ("is_link_local_ip6(ip6('febf::1'))", True), ("is_multicast_ip6(ip6('ff02::1'))", True),
        ("mac_to_string(mac('0:1b:2C:3d:4e:5f'))", "00:1b:2c:3d:4e:5f"), ("mac_to_string(mac('001b2c3d4e5f'))", "00:1b:2c:3d:4e:5f"), ("mac('00:11')", None), ("mac('00-11:22-33-44-55')", None), ("mac_is_broadcast(mac('ffffffffffff'))", True),
        ("mac_is_multicast(mac('01005e000001'))", True), ("mac_is_local(mac('020000000000'))", True), ("tcp_flags_str(18)", "SYN,ACK"), ("tcp_flags_str(0)", ""), ("tcp_flags_str(511)", "FIN,SYN,RST,PSH,ACK,URG,ECE,CWR,NS"),
        ("has_tcp_flag(2, 'Syn')", True), ("has_tcp_flag(2, 'zzz')", False), ("has_tcp_flag(NULL, 'syn')", None), ("dns_type_name(28)", "AAAA"), ("dns_type_name(1000)", "TYPE1000"), ("dns_rcode_name(3)", "NXDOMAIN"),
        ("dns_class_name(2)", "CLASS2"), ("icmp_type_name(13)", "Timestamp"), ("icmp_code_name(3, 4)", "Fragmentation Needed"), ("icmp_code_name(3, 99)", "Destination Unreachable (code 99)"), ("icmp_code_name(0, 0)", "No Code"),
        ("icmpv6_code_name(2, 5)", "Packet Too Big"), ("icmpv6_code_name(1, 4)", "Port Unreachable"), ("ip_proto_name(6)", "TCP"), ("ip_proto_name(61)", "Proto 61"), ("ethertype_name(2048)", "IPv4"), ("ethertype_name(4660)", "0x1234"),
        ("bgp_origin_name(9)", "Unknown (9)"), ("ospf_lsa_type_name(11)", "Opaque-AS-LSA"), ("gtp_message_type_name(255)", "G-PDU"), ("ntp_stratum_name(3)", "Secondary (stratum 3)"), ("ntp_stratum_name(17)", "Reserved (17)"),
        ("tls_version_name(772)", "TLS 1.3"), ("tls_version_name(6682)", "GREASE"), ("tls_version_name(1)", "Unknown (0x0001)"), ("tls_record_type_name(23)", "ApplicationData"), ("pcap_hex(X'0AFF')", "0aff"), ("pcap_hex(pcap_unhex(' 0XaB '))", "ab"),
        ("pcap_unhex('abc')", None), ("datetime(TIMESTAMP_NTZ'2024-01-01 12:34:56.789012')", "2024-01-01T12:34:56.789012"), ("fmt_time(TIMESTAMP_NTZ'2024-01-01 12:34:56.789012')", "12:34:56.789012"),
        ("epoch(TIMESTAMP_NTZ'2024-01-01 12:34:56.789012')", 1704112496.789012), ("epoch_ms(TIMESTAMP_NTZ'2024-01-01 12:34:56.789012')", 1704112496789), ("strftime('%Y/%j %H:%M:%S%.3f %p %s %%', TIMESTAMP_NTZ'2024-01-01 12:34:56.789012')", "2024/001 12:34:56.789 PM 1704112496 %"),
        ("strftime('%T %F %D %e', NULL)", None), ("array_join(format_ip4_list(array(1, 4294967295)), ' ')", "0.0.0.1 255.255.255.255"), ("array_join(format_mac_list(array(X'000000000001')), '')", "00:00:00:00:00:01"),
        ("array_join(format_ip6_list(array(ip6('::1'))), '')", "::1"),
    ],
)
def test_functions(spark, call, want):
    if not getattr(spark, "_registered", False):
        catalogue.register(spark)
        spark._registered = True
    assert spark.sql(f"SELECT {call}").first()[0] == want


def test_unknown_time_code_is_an_error():
    import pandas as pd

    with pytest.raises(ValueError):
        catalogue.strftime_text("%q", pd.Timestamp("2024-01-01"))


@pytest.mark.parametrize(
    "text,sql",
    [
        ("tcp", "tcp.frame_number IS NOT NULL"), ("TCP", "tcp.frame_number IS NOT NULL"), ("icmp6", "icmpv6.frame_number IS NOT NULL"), ("host 192.168.1.1", "(ipv4.src_ip = ip4('192.168.1.1') OR ipv4.dst_ip = ip4('192.168.1.1'))"),
        ("src host ::1", "ipv6.src_ip = ip6('::1')"), ("dst tcp port 8080", "tcp.dst_port = 8080"), ("tcp dst port 8080", "tcp.dst_port = 8080"), ("src port 80", "(tcp.src_port = 80 OR udp.src_port = 80)"),
        ("udp portrange 80-90", "(udp.src_port BETWEEN 80 AND 90 OR udp.dst_port BETWEEN 80 AND 90)"), ("src net 10.0.0.0/8", "ip_in_cidr(ipv4.src_ip, '10.0.0.0/8')"), ("dst net 2001:db8::/32", "ip6_in_cidr(ipv6.dst_ip, '2001:db8::/32')"),
        ("proto 6", "ipv4.protocol = 6"), ("not tcp", "NOT (tcp.frame_number IS NOT NULL)"), ("!tcp", "NOT (tcp.frame_number IS NOT NULL)"), ("tcp && udp || arp", "((tcp.frame_number IS NOT NULL) AND (udp.frame_number IS NOT NULL)) OR (arp.frame_number IS NOT NULL)"),
        ("(tcp or udp) and ip", "((tcp.frame_number IS NOT NULL) OR (udp.frame_number IS NOT NULL)) AND (ipv4.frame_number IS NOT NULL)"),
    ],
)
def test_filters(text, sql):
    assert filters.to_sql(filters.parse(text)) == sql


@pytest.mark.parametrize("text", ["", "port", "port 65536", "net 10.0.0.0/33", "net 10.0.0.0", "host x", "tcp tcp", "(tcp", "tcp)", "src tcp", "portrange 80", "proto 256", "and", "not"])
def test_filter_errors(text):
    with pytest.raises(filters.FilterError):
        filters.parse(text)
