"""Outermost headers of Ethernet frames by expressions alone.

Link, IPv4 and transport headers have fixed places, so their fields are arithmetic on the bytes: the
plan is one projection, filters on it stay in generated code, and unused fields are pruned. Use it for
scans that ask for the outer layers only; tunnels and all other protocols need the decoders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(data: Column, at: Column | int, size: int) -> Column:
    """Big-endian number of ``size`` bytes at an offset; NULL where the data ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.to_char(part, F.lit("hex")), 16, 10).cast("long"))


def outer_headers(frames: DataFrame) -> DataFrame:
    """``frame_number, src_mac, dst_mac, vlan_id, ethertype, src_ip, dst_ip, ttl, protocol, total_length,
    src_port, dst_port, tcp_flags`` of every Ethernet frame with a whole link header.

    Up to two VLAN tags are stepped over. Network fields are NULL unless a whole IPv4 header follows,
    ports unless the packet is the first fragment of TCP or UDP, flags unless its TCP header is whole.
    Frames with NULL data and other link types give no row.
    """
    raw = F.col("raw_data")
    tag = [0x8100, 0x88A8]
    base = frames.where((F.col("link_type") == 1) & (F.length("raw_data") >= 14)).select("frame_number", raw, number(raw, 12, 2).alias("t0"))
    base = base.withColumn("t1", F.when(F.col("t0").isin(tag), number(raw, 16, 2))).withColumn("t2", F.when(F.col("t1").isin(tag), number(raw, 20, 2)))
    net = F.when(F.col("t2").isNotNull(), F.lit(22)).when(F.col("t1").isNotNull(), F.lit(18)).otherwise(F.lit(14))
    base = base.withColumns({"at": net, "kind": F.coalesce("t2", "t1", "t0")}).withColumn("first", F.when(F.col("kind") == 0x0800, number(raw, F.col("at"), 1)))
    size = F.col("first").bitwiseAND(15) * 4
    whole = (F.shiftright("first", 4) == 4) & (size >= 20) & (F.length("raw_data") >= F.col("at") + size)
    base = base.withColumns({"ihl": F.when(whole, size.cast("int"))})
    field = lambda at, n: F.when(F.col("ihl").isNotNull(), number(raw, F.col("at") + at, n))
    base = base.withColumns({"protocol": field(9, 1), "frag": field(6, 2)})
    l4 = F.when((F.col("frag").bitwiseAND(0x1FFF) == 0) & F.col("protocol").isin(6, 17), F.col("at") + F.col("ihl"))
    enough = F.length("raw_data") >= l4 + F.when(F.col("protocol") == 6, 20).otherwise(8)
    base = base.withColumn("l4", F.when(enough, l4))
    return base.select(
        "frame_number", F.substring(raw, 7, 6).alias("src_mac"), F.substring(raw, 1, 6).alias("dst_mac"), F.when(F.col("t1").isNotNull(), number(raw, 14, 2).bitwiseAND(0xFFF)).cast("int").alias("vlan_id"),
        F.col("kind").cast("int").alias("ethertype"), field(12, 4).alias("src_ip"), field(16, 4).alias("dst_ip"), field(8, 1).cast("short").alias("ttl"), F.col("protocol").cast("short").alias("protocol"),
        field(2, 2).cast("int").alias("total_length"), number(raw, F.col("l4"), 2).cast("int").alias("src_port"), number(raw, F.col("l4") + 2, 2).cast("int").alias("dst_port"),
        F.when(F.col("protocol") == 6, number(raw, F.col("l4") + 12, 2).bitwiseAND(0x1FF)).cast("int").alias("tcp_flags"),
    )
