from __future__ import annotations

import bz2
import gzip
import lzma
import sqlite3
import struct
import subprocess
import sys

import packets as P
import pyarrow as pa
import pytest
import zstandard

from wirelake import cli, engine, schema
from wirelake.decode.outer import outer_headers
from wirelake.engine import Engine
from wirelake.plans.views import VIEWS
from wirelake.sources import container, datasource, sinks

FRAMES = [P.eth(P.ip(P.tcp(12345, 80), 6)), P.eth(P.ip(P.udp(4000, 53, P.dns_query("a.test")), 17)), P.eth(P.ip(P.udp(53, 4000, P.dns_answer("a.test")), 17)), P.eth(P.ip(struct.pack(">BBHHH", 8, 0, 0, 1, 1), 1))]


def lz4(data: bytes) -> bytes:
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "lz4") as f:
        f.write(data)
    return out.getvalue().to_pybytes()


def test_every_container_gives_the_same_rows(tmp_path):
    plain = {"le.pcap": P.pcap(FRAMES), "be.pcap": P.pcap(FRAMES, order=">"), "ns.pcap": P.pcap(FRAMES, nano=True), "a.pcapng": P.pcapng([(0, f) for f in FRAMES], [1]), "n.pcapng": P.pcapng([(0, f) for f in FRAMES], [1], nano=True)}
    want = [(1_700_000_000_000_000 + i * 1000, len(f), 1, f) for i, f in enumerate(FRAMES)]
    for n, data in plain.items():
        for pack in (bytes, gzip.compress, bz2.compress, lzma.compress, zstandard.compress, lz4):
            p = tmp_path / n
            p.write_bytes(pack(data))
            with open(p, "rb") as f:
                assert list(container.records(container.opened(f))) == want, (n, pack)


def test_broken_files(tmp_path):
    for data in (b"", b"ab", b"none of it"):
        (tmp_path / "x").write_bytes(data)
        with open(tmp_path / "x", "rb") as f, pytest.raises(container.CaptureError):
            list(container.records(container.opened(f)))
    (tmp_path / "x").write_bytes(P.pcap(FRAMES)[:-3])
    with open(tmp_path / "x", "rb") as f:
        assert len(list(container.records(container.opened(f)))) == len(FRAMES) - 1


def test_splits_and_link_types(spark, tmp_path):
    many = FRAMES * 50
    (tmp_path / "m.pcap").write_bytes(P.pcap(many))
    df = datasource.frames(spark, str(tmp_path / "m.pcap"), splitBytes="2000")
    assert df.rdd.getNumPartitions() > 3
    rows = df.orderBy("frame_number").collect()
    assert [bytes(r.raw_data) for r in rows] == many and [r.frame_number for r in rows] == list(range(1, 201))
    (tmp_path / "two.pcapng").write_bytes(P.pcapng([(0, FRAMES[0]), (1, FRAMES[0][14:])], [1, 101]))
    assert [r.link_type for r in datasource.frames(spark, str(tmp_path / "two.pcapng")).orderBy("frame_number").collect()] == [1, 101]
    both = engine.read_pcap(spark, str(tmp_path / "*.pcap*"))
    assert both.count() == 202 and both.select("frame_number").distinct().count() == 202


@pytest.mark.parametrize("store,cache", [(False, True), (True, False), (False, False)])
def test_engine_tables_and_views(spark, tmp_path, store, cache):
    inner = P.ip(P.tcp(5, 6), 6, "10.1.1.1", "10.1.1.2")
    frames = [*FRAMES, P.eth(P.ip(P.udp(9, 4789, b"\x08\0\0\0" + (100 << 8).to_bytes(4, "big") + P.eth(inner)), 17)), P.eth(P.ip6(inner, 4), 0x86DD), P.eth(P.ip6(P.ip6(P.udp(1, 2, b""), 17), 41), 0x86DD)]
    (tmp_path / "c.pcap").write_bytes(P.pcap(frames))
    e = Engine.open(spark, str(tmp_path / "c.pcap"), store=str(tmp_path / "s") if store else None, cache=cache)
    for t in schema.TABLES:
        want = schema.spark_schema(t).simpleString()
        assert e.table(t).schema.simpleString() == (want if t != "http2" else want[:-1] + ",connection_id:bigint>"), t
    # the two encapsulated segments meet both layers of their frames
    assert e.sql("SELECT count(*) FROM tcp").first()[0] == 3 and e.sql("SELECT count(*) FROM tcp_packets").first()[0] == 6
    assert [tuple(r) for r in e.sql("SELECT frame_number, tunnel_type, tunnel_id, encap_depth FROM ipv4 WHERE encap_depth > 0 ORDER BY 1").collect()] == [(5, "vxlan", 100, 1), (6, "ip4inip6", None, 1)]
    assert e.sql("SELECT query_name, transport FROM dns_packets").distinct().collect()[0] == ("a.test", "UDP")
    got = {r.frame_number: r for r in e.sql("SELECT * FROM tunneled_packets").collect()}
    assert set(got) == {5, 6, 7} and got[5].outer_src_ipv4 == 3232235876 and got[7].outer_next_header == 41
    assert e.sql("SELECT count(*) FROM ip4_in_ip6").first()[0] == 1 and e.sql("SELECT count(*) FROM ip6_in_ip6").first()[0] == 1
    for v in VIEWS:
        e.sql(f"SELECT * FROM {v.name}").collect()
    assert e.sql("SELECT relative_time(timestamp) FROM frames ORDER BY 1 DESC").first()[0] == pytest.approx(0.006)
    assert [r.frame_number for r in e.sql("SELECT frame_number FROM frames", filter="udp and port 53").collect()] == [2, 3]
    assert {r[0] for r in e.sql("SELECT frame_number FROM frames", filter="not ip").collect()} == {7}
    assert engine.stats(spark).first().cnt == 4 and engine.top(spark, "src_port").count() > 0 and engine.histogram(spark, "length").count() > 0
    assert engine.hexdump(spark, 1).startswith("00000000  02 00 00 00 00 02") and engine.time_info(spark).first().frames == 7
    e.close()


def test_empty_capture_gives_empty_tables(spark, tmp_path):
    (tmp_path / "e.pcap").write_bytes(P.pcap([]))
    e = Engine.open(spark, str(tmp_path / "e.pcap"))
    assert all(e.table(t).count() == 0 for t in ("frames", "tcp", "http2", "tcp_connections"))


def test_catalogue(spark):
    assert engine.protocols(spark).count() == 27 and engine.protocol_schema(spark, "dns").count() == 26 and engine.cache_stats(spark).columns[-1] == "memory_bytes"
    assert engine.protocol_schema(spark).where("table_name = 'tcp'").count() == 28


def test_exports(spark, tmp_path):
    (tmp_path / "c.pcap").write_bytes(P.pcap(FRAMES))
    e = Engine.open(spark, str(tmp_path / "c.pcap"))
    df = e.sql("SELECT frame_number, timestamp, src_ip, src_mac, answer_ttls FROM frames JOIN ipv4 USING (frame_number) JOIN ethernet USING (frame_number) LEFT JOIN dns USING (frame_number)")
    for name, kind in (("o.parquet", "parquet"), ("o.jsonl", "json"), ("o.csv", "csv"), ("o", "parquet")):
        sinks.write(df, str(tmp_path / name))
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / name)).count() == 4
    assert "192.168.1.100" in {r.src_ip for r in spark.read.option("header", True).csv(str(tmp_path / "o.csv")).collect()}
    sinks.write(df, str(tmp_path / "o.db"))
    with sqlite3.connect(tmp_path / "o.db") as con:
        rows = con.execute("SELECT frame_number, timestamp, typeof(src_mac), answer_ttls FROM data ORDER BY 1").fetchall()
    assert rows[0] == (1, "2023-11-14T22:13:20.000000", "blob", None) and rows[2][3] == "[300,300,300]"
    assert "02:00:00:00:00:01" in sinks.text_table(df)


def test_command_line(spark, tmp_path):
    (tmp_path / "c.pcap").write_bytes(P.pcap(FRAMES))
    assert cli.size("64M") == 64 * 1024**2 and cli.size("10") == 10 and cli.statements("a; b';'; c") == ["a", "b';'", "c"]
    # in a process of its own, as it shadows names of Spark's functions
    query = "SELECT ip4_to_string(src_ip) AS s, date(timestamp) AS d, hex(src_mac) AS m FROM ipv4 JOIN frames USING (frame_number) JOIN ethernet USING (frame_number)"
    run = subprocess.run([sys.executable, "-m", "wirelake.cli", str(tmp_path / "c.pcap"), "--master", "local[2]", "-e", query, "--filter", "", "--format", "csv"], capture_output=True, text=True, timeout=200)
    assert "192.168.1.100,2023-11-14,020000000001" in run.stdout, run.stderr[-2000:]
    e = Engine.open(spark, str(tmp_path / "c.pcap"))
    for line in (".tables", ".schema dns", ".protocols", ".udfs", ".stats", ".timeinfo", ".top src_port 3", ".histogram length", ".hexdump 1", ".cachestats", ".help", ".nonsense", f".export {tmp_path}/x.csv SELECT * FROM udp;"):
        assert cli.command(spark, line, e)
    assert cli.command(spark, ".quit", e) is None
    assert cli.key_log_text(str(tmp_path / "none")) == ""


def test_table_functions(spark, tmp_path):
    (tmp_path / "c.pcap.gz").write_bytes(gzip.compress(P.pcap(FRAMES)))
    Engine.open(spark, str(tmp_path / "c.pcap.gz"), streams=False)
    path = str(tmp_path / "c.pcap.gz")
    assert spark.sql(f"SELECT frame_number, length, link_type FROM read_pcap('{path}')").collect()[0] == (1, 54, 1)
    assert spark.sql(f"SELECT ttl FROM read_pcap('{path}', 'ipv4')").first().ttl == spark.sql(f"SELECT ttl FROM read_ipv4('{path}')").first().ttl
    assert [r[0] for r in spark.sql(f"SELECT query_name FROM read_dns('{path}')").collect()] == ["a.test"] * 2
    assert spark.sql(f"SELECT * FROM read_tcp('{path}')").schema.simpleString() == schema.spark_schema("tcp").simpleString() and spark.sql(f"SELECT * FROM read_bgp('{path}')").count() == 0
    assert spark.sql("SELECT * FROM pcap_protocols()").count() == 27 and spark.sql("SELECT * FROM pcap_schema('udp')").count() == 8


def test_outer_headers_agree_with_the_decoders(spark, tmp_path):
    tagged = P.eth(struct.pack(">HH", 5, 0x8100) + struct.pack(">HH", 6, 0x0800) + P.ip(P.tcp(7, 8, flags=18), 6), 0x88A8)
    whole = [*FRAMES, tagged, P.eth(P.ip(P.udp(1, 2, b"x"), 17, frag=5)), P.eth(P.ip6(P.udp(1, 2, b""), 17), 0x86DD)]
    frames = whole + [f[:n] for f in whole for n in (5, 14, 20, 35, 41, 50)]
    (tmp_path / "o.pcap").write_bytes(P.pcap(frames))
    df = engine.read_pcap(spark, str(tmp_path / "o.pcap"), "ethernet")
    got = {r.frame_number: r for r in outer_headers(datasource.frames(spark, str(tmp_path / "o.pcap"))).collect()}
    assert set(got) == {r.frame_number for r in df.where("ethertype IS NOT NULL").collect()}
    net = {r.frame_number: r for r in engine.read_pcap(spark, str(tmp_path / "o.pcap"), "ipv4").collect()}
    ports = {r.frame_number: r for t in ("tcp", "udp") for r in engine.read_pcap(spark, str(tmp_path / "o.pcap"), t).collect()}
    for n, r in got.items():
        i, t = net.get(n), ports.get(n)
        assert (r.src_ip, r.ttl, r.protocol, r.total_length) == ((i.src_ip, i.ttl, i.protocol, i.total_length) if i else (None,) * 4), n
        if r.ethertype == 0x0800:
            assert (r.src_port, r.dst_port) == ((t.src_port, t.dst_port) if t else (None, None)), n
    assert got[5].vlan_id == 5 and got[5].tcp_flags == 18
