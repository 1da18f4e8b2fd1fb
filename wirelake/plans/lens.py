"""Packet-shaped relations over the driver's tables, in SQL that Spark and DuckDB both run.

The test directories hold ``frames``, ``ipv4``, ``dns``, ``tls``, ``segments``, ``tcp_connections`` and
``http2_streams``; transport headers are derived from ``segments``, ``dns`` and ``events`` by integer
arithmetic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from wirelake.functions.catalogue import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "frames", "ipv4", "segments", "tcp_connections", "dns", "tls", "http2_streams")

#: name -> SQL of the derived relation
DERIVED = {
    "pkt": "SELECT DISTINCT frame_number, ts, length, original_length FROM frames WHERE ts >= TIMESTAMP '1971-01-01 00:00:00'",
    "ip": "SELECT DISTINCT * FROM ipv4",
    "tcp": """SELECT s.frame_number, CAST(1024 + s.connection_id % 60000 AS INT) AS src_port, CAST(CASE s.connection_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 22 ELSE 8443 END AS INT) AS dst_port,
        s.seq, CAST((s.seq + s.frame_number) % 512 AS INT) AS flags, s.data_len FROM (SELECT DISTINCT connection_id, direction, seq, data_len, frame_number FROM segments) s""",
    "udp": "SELECT frame_number, CAST(1024 + transaction_id % 60000 AS INT) AS src_port, CAST(53 AS INT) AS dst_port, CAST(40 + transaction_id % 400 AS INT) AS length FROM (SELECT DISTINCT frame_number, transaction_id FROM dns)",
    "query": "SELECT frame_number, transaction_id, is_query, response_code, query_name, query_type, query_class, answer_count, answer_ip4s, answer_ttls FROM (SELECT DISTINCT * FROM dns)",
    "code": """SELECT event_id, CAST(event_id % 300 AS INT) AS n8, CAST((event_id * 257) % 70000 AS INT) AS n16, CAST(event_id % 20 AS INT) AS t, CAST((event_id * 7) % 18 AS INT) AS c,
        CAST((user_id * 2654435761) % 4294967296 AS BIGINT) AS address FROM events""",
}


def with_derived(sql: str) -> str:
    """``sql`` with the derived relations it mentions in front, as common table expressions."""
    used = [n for n in DERIVED if f" {n} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ").replace("(", " ")]
    head = ", ".join(f"{n} AS ({DERIVED[n]})" for n in used)
    if not head:
        return sql
    rest = sql.lstrip()
    return f"WITH {head}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {head} {rest}"


def run(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A query over the directory's tables and the derived relations."""
    register(spark)
    sql = with_derived(sql)
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
