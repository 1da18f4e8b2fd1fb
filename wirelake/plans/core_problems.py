"""Queries of the general data problems, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelake.operators.dense import heavy_sources
from wirelake.operators.sessions import segment_sessions
from wirelake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_sources(table(spark, d, "ipv4"), table(spark, d, "frames"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return segment_sessions(table(spark, d, "segments"), table(spark, d, "ipv4"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found}

ORACLES = {
    "p1_found": """
        WITH days AS (SELECT DISTINCT frame_number, strftime(ts, '%Y-%m-%d') AS day FROM frames WHERE ts >= TIMESTAMP '1971-01-01'),
        r AS (SELECT day, src_ip, total_length, frame_number FROM (SELECT DISTINCT * FROM ipv4) JOIN days USING (frame_number)),
        t AS (SELECT day, count(*) AS n FROM r GROUP BY day),
        g AS (SELECT day, src_ip, count(*) AS n, max(total_length) AS top FROM r WHERE src_ip IS NOT NULL GROUP BY day, src_ip)
        SELECT g.day, g.src_ip, min(r.frame_number) AS frame_number
        FROM g JOIN t USING (day) LEFT JOIN r ON r.day = g.day AND r.src_ip = g.src_ip AND r.total_length = g.top
        WHERE g.n >= 20 AND g.n * 50 >= t.n GROUP BY g.day, g.src_ip""",
    "p2_found": """
        WITH s AS (SELECT connection_id, frame_number, epoch_us(ts) AS t FROM (SELECT DISTINCT * FROM segments) WHERE ts >= TIMESTAMP '1971-01-01'),
        ip AS (SELECT frame_number, src_ip FROM (SELECT frame_number, src_ip, row_number() OVER (PARTITION BY frame_number ORDER BY encap_depth DESC NULLS LAST, src_ip DESC NULLS LAST) AS k FROM ipv4) WHERE k = 1),
        e AS (SELECT 'connection' AS entity, connection_id AS entity_id, t FROM s WHERE connection_id IS NOT NULL
              UNION ALL SELECT 'src_ip', src_ip, t FROM s JOIN ip USING (frame_number) WHERE src_ip IS NOT NULL),
        m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 300000000 THEN 0 ELSE 1 END AS starts FROM e WINDOW w AS (PARTITION BY entity, entity_id ORDER BY t)),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY entity, entity_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM m)
        SELECT entity, entity_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_segments FROM n GROUP BY entity, entity_id, session""",
}
