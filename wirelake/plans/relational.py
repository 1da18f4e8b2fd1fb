"""Relational coverage: the same text runs on Spark and, as the check, on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelake.plans.lens import run, with_derived

#: name -> SQL that both engines run unchanged
SHARED = {
    "scan_frames": "SELECT frame_number, length, original_length, link_type FROM frames",
    "project_computed": "SELECT frame_number, length * 8 AS bits, original_length - length AS cut, CAST(length AS DOUBLE) / original_length AS share FROM frames WHERE original_length > 0",
    "filter_compare": "SELECT frame_number, src_ip, ttl FROM ipv4 WHERE ttl >= 64 AND total_length > 100 AND protocol <> 17",
    "filter_in_between_like": "SELECT frame_number, query_name FROM query WHERE query_type IN (1, 28) AND transaction_id BETWEEN 1000 AND 60000 AND query_name LIKE '%.test'",
    "filter_null": "SELECT frame_number FROM ipv4 WHERE protocol IS NULL OR tunnel_type IS NOT NULL",
    "case_coalesce": "SELECT frame_number, CASE WHEN total_length < 100 THEN 'small' WHEN total_length < 1000 THEN 'medium' ELSE 'large' END AS size_class, coalesce(tunnel_type, 'none') AS tunnel, nullif(protocol, 6) AS not_tcp FROM ipv4",
    "join_inner": "SELECT p.frame_number, p.length, i.src_ip, i.dst_ip FROM pkt p JOIN ip i ON p.frame_number = i.frame_number",
    "join_left": "SELECT p.frame_number, q.query_name FROM pkt p LEFT JOIN query q ON p.frame_number = q.frame_number",
    "join_right": "SELECT q.frame_number, p.length FROM pkt p RIGHT JOIN query q ON p.frame_number = q.frame_number",
    "join_full": "SELECT coalesce(p.frame_number, i.frame_number) AS frame_number, p.length, i.ttl FROM pkt p FULL OUTER JOIN ip i ON p.frame_number = i.frame_number",
    "join_semi": "SELECT p.frame_number FROM pkt p WHERE EXISTS (SELECT 1 FROM query q WHERE q.frame_number = p.frame_number)",
    "join_anti": "SELECT i.frame_number FROM ip i WHERE NOT EXISTS (SELECT 1 FROM pkt p WHERE p.frame_number = i.frame_number)",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "join_theta": "SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey",
    "join_using": "SELECT frame_number, t.dst_port, i.ttl FROM tcp t JOIN ip i USING (frame_number) WHERE i.encap_depth = 0",
    "join_self_depth": "SELECT a.frame_number, a.src_ip AS inner_src, b.src_ip AS outer_src, a.tunnel_type FROM ip a JOIN ip b ON a.frame_number = b.frame_number AND b.encap_depth = a.encap_depth - 1 WHERE a.encap_depth > 0",
    "view_tcp_shape": "SELECT p.frame_number, p.length, i.src_ip AS src_ip_v4, i.dst_ip AS dst_ip_v4, i.ttl, t.src_port, t.dst_port, t.flags FROM pkt p LEFT JOIN ip i ON p.frame_number = i.frame_number JOIN tcp t ON p.frame_number = t.frame_number",
    "view_dns_shape": """SELECT p.frame_number, i.src_ip AS src_ip_v4, coalesce(t.src_port, u.src_port) AS src_port, CASE WHEN t.frame_number IS NOT NULL THEN 'TCP' ELSE 'UDP' END AS transport, q.query_name, q.response_code
        FROM pkt p LEFT JOIN ip i ON p.frame_number = i.frame_number LEFT JOIN tcp t ON p.frame_number = t.frame_number LEFT JOIN udp u ON p.frame_number = u.frame_number JOIN query q ON p.frame_number = q.frame_number""",
    "view_tunneled_shape": """SELECT p.frame_number, i.src_ip AS inner_src_ipv4, i.encap_depth, i.tunnel_type, i.tunnel_id, o.src_ip AS outer_src_ipv4, o.protocol AS outer_proto_v4
        FROM pkt p JOIN ip i ON p.frame_number = i.frame_number AND i.encap_depth > 0 LEFT JOIN ip o ON p.frame_number = o.frame_number AND o.encap_depth = i.encap_depth - 1""",
    "view_udp_shape": "SELECT p.frame_number, p.length, i.src_ip AS src_ip_v4, i.dst_ip AS dst_ip_v4, u.src_port, u.dst_port, u.length AS udp_length FROM pkt p LEFT JOIN ip i ON p.frame_number = i.frame_number JOIN udp u ON p.frame_number = u.frame_number",
    "view_tls_shape": """SELECT p.frame_number, i.src_ip AS src_ip_v4, t.src_port, t.dst_port, t.flags AS tcp_flags, x.record_type, x.version, x.handshake_type, x.sni
        FROM pkt p LEFT JOIN ip i ON p.frame_number = i.frame_number JOIN tcp t ON p.frame_number = t.frame_number JOIN (SELECT DISTINCT * FROM tls) x ON p.frame_number = x.frame_number""",
    "view_packets_shape": """SELECT p.frame_number, p.length, i.version AS ip_version, i.src_ip AS src_ip_v4, i.ttl AS ip_ttl, coalesce(t.src_port, u.src_port) AS src_port, coalesce(t.dst_port, u.dst_port) AS dst_port,
        CASE WHEN t.frame_number IS NOT NULL THEN 'TCP' WHEN u.frame_number IS NOT NULL THEN 'UDP' WHEN i.protocol = 1 THEN 'ICMP' END AS protocol, t.flags AS tcp_flags, q.query_name AS dns_query_name, q.is_query AS dns_is_query, x.sni AS tls_sni
        FROM pkt p LEFT JOIN ip i ON p.frame_number = i.frame_number LEFT JOIN tcp t ON p.frame_number = t.frame_number LEFT JOIN udp u ON p.frame_number = u.frame_number LEFT JOIN query q ON p.frame_number = q.frame_number
        LEFT JOIN (SELECT DISTINCT * FROM tls) x ON p.frame_number = x.frame_number""",
    "http2_by_connection": """SELECT c.connection_id, c.client_ip, count(h.stream_id) AS streams, CAST(coalesce(sum(h.response_body_len), 0) AS BIGINT) AS body_bytes, count(*) FILTER (WHERE h.status >= 400) AS failed
        FROM tcp_connections c LEFT JOIN (SELECT DISTINCT * FROM http2_streams) h ON h.connection_id = c.connection_id GROUP BY c.connection_id, c.client_ip""",
    "dns_latency": """SELECT a.transaction_id, a.frame_number AS asked, min(b.frame_number) AS answered FROM query a JOIN query b ON a.transaction_id = b.transaction_id AND a.query_name = b.query_name AND a.is_query AND NOT b.is_query AND b.frame_number > a.frame_number
        GROUP BY a.transaction_id, a.frame_number""",
    "agg_group": "SELECT protocol, count(*) AS n, CAST(sum(total_length) AS BIGINT) AS bytes, min(ttl) AS low, max(ttl) AS high FROM ipv4 GROUP BY protocol",
    "agg_distinct": "SELECT protocol, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS targets FROM ipv4 GROUP BY protocol",
    "agg_filter": "SELECT query_type, count(*) FILTER (WHERE is_query) AS asked, count(*) FILTER (WHERE response_code = 3) AS missing FROM query GROUP BY query_type",
    "agg_stats": "SELECT protocol, round(avg(total_length), 6) AS mean, round(stddev_pop(total_length), 6) AS spread, round(var_pop(total_length), 4) AS variance, round(corr(total_length, ttl), 8) AS related FROM ipv4 WHERE protocol IS NOT NULL GROUP BY protocol",
    "agg_bool": "SELECT state, bool_and(is_complete) AS every, bool_or(is_complete) AS some, bit_and(packets_to_server) AS common_bits, bit_or(packets_to_server) AS any_bits FROM tcp_connections GROUP BY state",
    "grouping_sets": "SELECT protocol, ecn, grouping(protocol) AS gp, grouping(ecn) AS ge, count(*) AS n FROM ipv4 GROUP BY GROUPING SETS ((protocol, ecn), (protocol), ())",
    "cube": "SELECT state, is_complete, count(*) AS n, CAST(sum(bytes_to_server) AS BIGINT) AS bytes FROM tcp_connections GROUP BY CUBE (state, is_complete)",
    "rollup": "SELECT state, server_port, count(*) AS n FROM tcp_connections GROUP BY ROLLUP (state, server_port)",
    "having": "SELECT src_ip, count(*) AS n FROM ip GROUP BY src_ip HAVING count(*) >= 50",
    "top_values": "SELECT src_ip, count(*) AS n FROM ip WHERE src_ip IS NOT NULL GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10",
    "histogram_buckets": """SELECT CAST(floor(floor(i.total_length / b.w) * b.w) AS BIGINT) AS bucket, count(*) AS n FROM ipv4 i CROSS JOIN (SELECT greatest((max(total_length) - min(total_length)) / 10.0, 1.0) AS w FROM ipv4) b
        WHERE i.total_length IS NOT NULL GROUP BY CAST(floor(floor(i.total_length / b.w) * b.w) AS BIGINT)""",
    "proto_distribution": "SELECT 'tcp' AS protocol, count(*) AS n FROM tcp UNION ALL SELECT 'udp', count(*) FROM udp UNION ALL SELECT 'dns', count(*) FROM query UNION ALL SELECT 'tls', count(*) FROM tls",
    "time_info": "SELECT CAST(min(ts) AS VARCHAR(40)) AS first_ts, CAST(max(ts) AS VARCHAR(40)) AS last_ts, count(*) AS n FROM pkt",
    "rank_family": """SELECT connection_id, server_ip, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
        FROM tcp_connections WINDOW w AS (PARTITION BY server_ip ORDER BY bytes_to_client DESC, connection_id)""",
    "lag_lead": "SELECT frame_number, connection_id, seq - lag(seq) OVER w AS step, lead(data_len, 1, -1) OVER w AS next_len FROM (SELECT DISTINCT * FROM segments) s WINDOW w AS (PARTITION BY connection_id, direction ORDER BY frame_number)",
    "running_sum": "SELECT frame_number, connection_id, CAST(sum(data_len) OVER (PARTITION BY connection_id, direction ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sent FROM (SELECT DISTINCT * FROM segments) s",
    "range_frame": "SELECT frame_number, connection_id, count(*) OVER (PARTITION BY connection_id ORDER BY frame_number RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) AS near FROM (SELECT DISTINCT * FROM segments) s",
    "first_last_nth": """SELECT frame_number, first_value(data_len) OVER w AS first_len, last_value(data_len) OVER w AS last_len, nth_value(data_len, 2) OVER w AS second_len
        FROM (SELECT DISTINCT * FROM segments) s WINDOW w AS (PARTITION BY connection_id ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "ntile": "SELECT connection_id, ntile(4) OVER (PARTITION BY server_ip ORDER BY duration_us NULLS LAST, connection_id) AS quarter FROM tcp_connections",
    "topk": "SELECT connection_id, duration_us FROM tcp_connections WHERE duration_us IS NOT NULL ORDER BY duration_us DESC, connection_id LIMIT 25",
    "order_nulls": "SELECT connection_id, duration_us FROM tcp_connections ORDER BY duration_us ASC NULLS FIRST, connection_id",
    "limit_offset": "SELECT connection_id FROM tcp_connections ORDER BY connection_id LIMIT 10 OFFSET 20",
    "union_all": "SELECT src_ip AS address FROM ip UNION ALL SELECT dst_ip FROM ip",
    "union_distinct": "SELECT src_ip AS address FROM ip UNION SELECT dst_ip FROM ip",
    "intersect": "SELECT src_ip AS address FROM ip INTERSECT SELECT dst_ip FROM ip",
    "except": "SELECT src_ip AS address FROM ip EXCEPT SELECT dst_ip FROM ip",
    "distinct": "SELECT DISTINCT protocol, encap_depth, tunnel_type FROM ipv4",
    "cte": "WITH heavy AS (SELECT src_ip, count(*) AS n FROM ip GROUP BY src_ip), cut AS (SELECT avg(n) AS mean FROM heavy) SELECT h.src_ip, h.n FROM heavy h CROSS JOIN cut c WHERE h.n > 3 * c.mean",
    "scalar_subquery": "SELECT frame_number, total_length FROM ip WHERE total_length = (SELECT max(total_length) FROM ip)",
    "in_exists": "SELECT connection_id, state FROM tcp_connections WHERE connection_id IN (SELECT connection_id FROM http2_streams WHERE status >= 400)",
    "correlated": "SELECT c.connection_id, (SELECT count(*) FROM http2_streams h WHERE h.connection_id = c.connection_id) AS streams FROM tcp_connections c",
    "values_list": "SELECT v.port, v.name, count(t.frame_number) AS n FROM (VALUES (443, 'https'), (80, 'http'), (22, 'ssh')) AS v(port, name) LEFT JOIN tcp t ON t.dst_port = v.port GROUP BY v.port, v.name",
    "string_family": """SELECT frame_number, lower(query_name) AS low, upper(query_name) AS up, length(query_name) AS len, substr(query_name, 1, 3) AS head, replace(query_name, '.', '-') AS dashed, reverse(query_name) AS back,
        lpad(query_name, 5, '*') AS padded, concat(query_name, '/', query_type) AS joined, ascii(query_name) AS code, split_part(query_name, '.', 1) AS label FROM query WHERE query_name IS NOT NULL AND query_name <> ''""",
    "pattern_family": "SELECT frame_number, query_name LIKE 'a%' AS starts, query_name ILIKE '%TEST%' AS has, regexp_replace(query_name, '[.]?[a-z]+[.]*$', '') AS head FROM query WHERE query_name IS NOT NULL",
    "math_family": """SELECT frame_number, abs(ttl - 64) AS d, CAST(ceil(total_length / 7.0) AS BIGINT) AS up, CAST(floor(total_length / 7.0) AS BIGINT) AS down, round(sqrt(total_length), 6) AS root, round(ln(total_length), 6) AS nat, round(log10(total_length), 6) AS dec,
        round(power(ttl, 2), 3) AS sq, sign(ttl - 64) AS s, total_length % 7 AS m, greatest(ttl, protocol) AS g, least(ttl, protocol) AS l FROM ipv4 WHERE total_length > 0""",
    "time_family": "SELECT frame_number, extract(hour FROM ts) AS hh, CAST(extract(day FROM date_trunc('month', ts)) AS INT) AS first_day, CAST(CAST(date_trunc('hour', ts) AS DATE) AS VARCHAR(20)) AS d FROM pkt",
    "conditional_family": "SELECT connection_id, coalesce(duration_us, -1) AS dur, nullif(state, 'closed') AS other, duration_us IS DISTINCT FROM 0 AS differs, CASE WHEN duration_us IS NULL THEN 'open' ELSE 'done' END AS k FROM tcp_connections",
    "cast_family": "SELECT event_id, CAST(value AS INT) + 0 AS whole, CAST(event_id AS VARCHAR(20)) AS txt, TRY_CAST(event_type AS INT) AS bad FROM (SELECT event_id, event_type, floor(value) AS value FROM events) e",
    "conn_aggregate": """SELECT connection_id, direction, count(*) AS segments, CAST(sum(data_len) AS BIGINT) AS bytes, min(frame_number) AS first_frame, max(frame_number) AS last_frame FROM (SELECT DISTINCT * FROM segments) s GROUP BY connection_id, direction""",
    "tpch_q1": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": """SELECT o.o_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey ORDER BY revenue DESC, o.o_orderkey LIMIT 20""",
    "tpch_q5": """SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""",
}

#: name -> (Spark SQL, DuckDB SQL) where the dialects part
TWO = {
    "approx_distinct_bound": (
        "SELECT protocol, abs(approx_count_distinct(src_ip, 0.01) - count(DISTINCT src_ip)) <= 0.05 * count(DISTINCT src_ip) + 1 AS close FROM ipv4 GROUP BY protocol",
        "SELECT protocol, true AS close FROM ipv4 GROUP BY protocol",
    ),
    "percentiles": (
        "SELECT protocol, percentile(total_length, 0.5) AS mid, percentile(total_length, 0.9) AS high, median(ttl) AS t FROM ipv4 WHERE protocol IS NOT NULL GROUP BY protocol",
        "SELECT protocol, quantile_cont(total_length, 0.5) AS mid, quantile_cont(total_length, 0.9) AS high, CAST(median(ttl) AS DOUBLE) AS t FROM ipv4 WHERE protocol IS NOT NULL GROUP BY protocol",
    ),
    "array_lists": (
        """SELECT frame_number, size(answer_ttls) AS n, array_max(answer_ttls) AS top, array_contains(answer_ttls, 900) AS has, array_join(transform(array_sort(array_distinct(answer_ttls)), x -> cast(x AS STRING)), ',') AS text,
            aggregate(answer_ttls, 0L, (a, x) -> a + x) AS total FROM query WHERE answer_ttls IS NOT NULL""",
        """SELECT frame_number, CAST(len(answer_ttls) AS INT) AS n, list_max(answer_ttls) AS top, list_contains(answer_ttls, 900) AS has, array_to_string(list_sort(list_distinct(answer_ttls)), ',') AS text,
            CAST(coalesce(list_sum(answer_ttls), 0) AS BIGINT) AS total FROM query WHERE answer_ttls IS NOT NULL""",
    ),
    "explode_list": (
        "SELECT frame_number, address, pos + 1 AS place FROM query LATERAL VIEW posexplode(answer_ip4s) x AS pos, address",
        "SELECT frame_number, unnest(answer_ip4s) AS address, CAST(unnest(range(1, len(answer_ip4s) + 1)) AS INT) AS place FROM query",
    ),
    "hash_family": (
        "SELECT event_id, md5(event_type) AS m, sha2(event_type, 256) AS s, hex(encode(event_type, 'UTF-8')) AS h FROM events",
        "SELECT event_id, md5(event_type) AS m, sha256(event_type) AS s, hex(encode(event_type)) AS h FROM events",
    ),
    "props_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    ),
    "date_bins": (
        "SELECT date_format(timestamp_micros((unix_micros(CAST(ts AS TIMESTAMP)) div 900000000) * 900000000), 'yyyy-MM-dd HH:mm') AS bin, count(*) AS n FROM pkt GROUP BY 1",
        "SELECT strftime(make_timestamp((epoch_us(ts) // 900000000) * 900000000), '%Y-%m-%d %H:%M') AS bin, count(*) AS n FROM pkt GROUP BY 1",
    ),
    "string_agg": (
        "SELECT connection_id, array_join(array_sort(collect_list(method)), '|') AS methods FROM http2_streams WHERE method IS NOT NULL GROUP BY connection_id",
        "SELECT connection_id, string_agg(method, '|' ORDER BY method) AS methods FROM http2_streams WHERE method IS NOT NULL GROUP BY connection_id",
    ),
    "conn_timeout_sessions": (
        """SELECT connection_id, session, min(frame_number) AS first_frame, count(*) AS n FROM (SELECT *, sum(starts) OVER (PARTITION BY connection_id ORDER BY t, frame_number) AS session FROM (SELECT connection_id, frame_number, unix_micros(CAST(ts AS TIMESTAMP)) AS t,
            CASE WHEN unix_micros(CAST(ts AS TIMESTAMP)) - lag(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY connection_id ORDER BY ts, frame_number) <= 300000000 THEN 0 ELSE 1 END AS starts FROM (SELECT DISTINCT * FROM segments) s) m) x GROUP BY connection_id, session""",
        """SELECT connection_id, CAST(session AS BIGINT) AS session, min(frame_number) AS first_frame, count(*) AS n FROM (SELECT *, sum(starts) OVER (PARTITION BY connection_id ORDER BY t, frame_number) AS session FROM (SELECT connection_id, frame_number, epoch_us(ts) AS t,
            CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY connection_id ORDER BY ts, frame_number) <= 300000000 THEN 0 ELSE 1 END AS starts FROM (SELECT DISTINCT * FROM segments) s) m) x GROUP BY connection_id, session""",
    ),
}


def _query(sql: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return run(spark, d, sql)

    return query


QUERIES = {n: _query(sql) for n, sql in SHARED.items()} | {n: _query(sql) for n, (sql, _) in TWO.items()}
ORACLES = {n: with_derived(sql) for n, sql in SHARED.items()} | {n: with_derived(sql) for n, (_, sql) in TWO.items()}
