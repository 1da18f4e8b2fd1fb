"""Queries of the training-data problems, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelake.llm import frequent, leakage, packing, radix, setsketch, subjects
from wirelake.session import table


def _identifiers(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, t) for t in ("ipv4", "dns", "tls", "frames"))


def _sizes(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, t) for t in ("ipv4", "http2_streams", "frames"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return setsketch.standout_days(*_identifiers(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return setsketch.daily_counts(*_identifiers(spark, d))


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return setsketch.day_overlaps(*_identifiers(spark, d))


def p3_counts_bound(spark: SparkSession, d: str) -> DataFrame:
    return setsketch.counts_within_error(*_identifiers(spark, d))


def p3_overlaps_bound(spark: SparkSession, d: str) -> DataFrame:
    return setsketch.overlaps_within_error(*_identifiers(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return radix.long_tails(*_sizes(spark, d))


def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return radix.day_and_week_quantiles(*_sizes(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.weekly_heavy_hitters(*_identifiers(spark, d))


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    return frequent.top_items(*_identifiers(spark, d))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.contaminated(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_places(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(*(table(spark, d, t) for t in ("documents", "doc_labels", "subjects", "eval_items"))).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p3_overlaps, p3_counts_bound, p3_overlaps_bound, p4_found, p4_quantiles, p5_found, p5_top, p6_containers, p7_found, p7_places, p8_found)}

_DAYS = "days AS (SELECT DISTINCT frame_number, CAST(ts AS DATE) AS day FROM frames WHERE ts >= TIMESTAMP '1971-01-01')"
_ITEMS = f"""{_DAYS},
    i AS (SELECT 'src_ip' AS ident, CAST(protocol AS VARCHAR) AS grp, CAST(src_ip AS VARCHAR) AS item, day FROM (SELECT DISTINCT * FROM ipv4) JOIN days USING (frame_number) WHERE src_ip IS NOT NULL
          UNION ALL SELECT 'query_name', CAST(query_type AS VARCHAR), lower(rtrim(query_name, '.')), day FROM (SELECT DISTINCT * FROM dns) JOIN days USING (frame_number) WHERE lower(rtrim(query_name, '.')) <> ''
          UNION ALL SELECT 'sni', version, lower(rtrim(sni, '.')), day FROM (SELECT DISTINCT * FROM tls) JOIN days USING (frame_number) WHERE lower(rtrim(sni, '.')) <> '')"""
_GROUPED = "e AS (SELECT ident, grp, day, item FROM i WHERE grp IS NOT NULL UNION ALL SELECT ident, '*', day, item FROM i)"
_QUANTILES = f"""{_DAYS},
    v AS (SELECT 'total_length' AS metric, CAST(protocol AS VARCHAR) AS grp, day, total_length AS value FROM (SELECT DISTINCT * FROM ipv4) JOIN days USING (frame_number) WHERE total_length IS NOT NULL AND protocol IS NOT NULL
          UNION ALL SELECT 'response_body_len', regexp_replace(lower(authority), ':443$', ''), day, response_body_len FROM (SELECT DISTINCT * FROM http2_streams) h JOIN days ON days.frame_number = h.request_frame WHERE response_body_len IS NOT NULL AND authority IS NOT NULL),
    w AS (SELECT metric, grp, 'day ' || strftime(day, '%Y-%m-%d') AS win, value FROM v UNION ALL SELECT metric, grp, 'week ' || strftime(date_trunc('week', day), '%Y-%m-%d'), value FROM v),
    q AS (SELECT metric, grp, win, CAST(count(*) AS BIGINT) AS n, CAST(quantile_disc(value, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(value, 0.95) AS BIGINT) AS p95 FROM w GROUP BY ALL)"""

ORACLES = {
    "p3_found": f"""WITH {_ITEMS},
        c AS (SELECT ident, grp, day, count(DISTINCT item) AS n FROM (SELECT ident, grp, day, item FROM i WHERE grp IS NOT NULL UNION ALL SELECT ident, '*', day, item FROM i) GROUP BY ALL),
        g AS (SELECT DISTINCT ident, grp, date_trunc('week', day) AS week FROM c),
        f AS (SELECT g.ident, g.grp, g.week, CAST(g.week + to_days(CAST(k AS INTEGER)) AS DATE) AS day, coalesce(c.n, 0) AS n
              FROM g CROSS JOIN range(7) AS r(k) LEFT JOIN c ON c.ident = g.ident AND c.grp = g.grp AND c.day = CAST(g.week + to_days(CAST(k AS INTEGER)) AS DATE)),
        m AS (SELECT *, median(n) OVER (PARTITION BY ident, grp, week) AS mid FROM f)
        SELECT ident, grp, strftime(day, '%Y-%m-%d') AS day FROM m WHERE n >= 20 AND n >= 2 * mid""",
    "p3_counts_bound": f"""WITH {_ITEMS}, {_GROUPED},
        w AS (SELECT ident, grp, 'day ' || strftime(day, '%Y-%m-%d') AS win, item FROM e UNION ALL SELECT ident, grp, 'week ' || strftime(date_trunc('week', day), '%Y-%m-%d'), item FROM e)
        SELECT ident, grp, win, count(DISTINCT item) AS n, TRUE AS within FROM w GROUP BY ALL""",
    "p3_overlaps_bound": f"""WITH {_ITEMS}, {_GROUPED}, u AS (SELECT DISTINCT * FROM e),
        d AS (SELECT *, lead(day) OVER (PARTITION BY ident, grp ORDER BY day) AS next_day FROM (SELECT DISTINCT ident, grp, day FROM u)),
        x AS (SELECT d.ident, d.grp, d.day, d.next_day, u.item FROM d JOIN u ON u.ident = d.ident AND u.grp = d.grp AND (u.day = d.day OR u.day = d.next_day) WHERE d.next_day IS NOT NULL),
        y AS (SELECT *, count(*) AS k FROM x GROUP BY ALL)
        SELECT ident, grp, strftime(day, '%Y-%m-%d') AS day, strftime(next_day, '%Y-%m-%d') AS next_day, count(*) AS n_union, count(*) FILTER (WHERE k = 2) AS n_both, TRUE AS within
        FROM y GROUP BY ident, grp, day, next_day""",
    "p4_found": f"WITH {_QUANTILES} SELECT metric, grp, win FROM q WHERE n >= 30 AND p50 > 0 AND p95 >= 8 * p50",
    "p4_quantiles": f"WITH {_QUANTILES} SELECT metric, grp, win, n, p50, p95 FROM q",
    "p5_found": f"""WITH {_ITEMS},
        c AS (SELECT ident, date_trunc('week', day) AS week, item, count(*) AS n FROM i GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER (PARTITION BY ident, week) AS total FROM c)
        SELECT ident, strftime(week, '%Y-%m-%d') AS week, item FROM t WHERE n >= 10 AND n * 100 >= total""",
}
