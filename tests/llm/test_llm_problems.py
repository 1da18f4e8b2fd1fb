"""The queries of the training-data problems on small tables with every kind of dirt."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wirelake.llm import frequent, plans, radix, setsketch

FRAMES = "frame_number long, t string, value string"


def tables(spark):
    rnd = random.Random(6)
    frames = [(n, rnd.choice([f"2024-01-0{rnd.randint(1, 9)} 10:00:00", "1970-01-01 00:00:00", None]), "x") for n in range(1, 900)]
    ipv4 = [(rnd.choice([*range(1, 950), None]), rnd.choice([None, 6, 17]), rnd.choice([None, 0, 10, 10, 20, 500]), rnd.randint(1, 5), "x") for _ in range(2500)]
    http2 = [(i, rnd.choice([None, *range(1, 900)]), rnd.choice([None, "A.test", "a.test:443", "b.test", ""]), rnd.choice([None, 0, 3, 3, 4, 900]), 1) for i in range(900)]
    f = spark.createDataFrame(frames + frames[:20], FRAMES).withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    return (
        f, spark.createDataFrame(ipv4 + ipv4[:99], "frame_number long, protocol int, total_length int, src_ip long, grp string"),
        spark.createDataFrame(http2 + http2[:30], "stream_id long, request_frame long, authority string, response_body_len long, metric int"), frames, ipv4, http2,
    )


def test_long_tails_against_brute_force(spark):
    import datetime as dt

    f, i, h, frames, ipv4, http2 = tables(spark)
    day = {n: dt.date.fromisoformat(t[:10]) for n, t, _ in frames if t and t > "1971"}
    groups: dict = {}

    def add(metric, grp, d, v):
        for w in (f"day {d}", f"week {d - dt.timedelta(days=d.weekday())}"):
            groups.setdefault((metric, grp, w), []).append(v)

    for n, p, v, *_ in set(ipv4):
        if n in day and p is not None and v is not None:
            add("total_length", str(p), day[n], v)
    for _, n, a, v, _ in set(http2):
        if n in day and a is not None and v is not None:
            add("response_body_len", a.lower().removesuffix(":443"), day[n], v)
    want, all_windows = set(), {}
    for k, vs in groups.items():
        vs.sort()
        p50, p95 = vs[-(-len(vs) // 2) - 1], vs[-(-19 * len(vs) // 20) - 1]
        all_windows[k] = (len(vs), p50, p95)
        if len(vs) >= 30 and p50 > 0 and p95 >= 8 * p50:
            want.add(k)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in radix.day_and_week_quantiles(i, h, f).collect()} == all_windows
    assert {tuple(r) for r in radix.long_tails(i, h, f).collect()} == want and want
    assert radix.long_tails(i.limit(0), h.limit(0), f).count() == 0 and radix.long_tails(i, h, f.limit(0)).count() == 0


def test_empty_tables(spark):
    f, i, _, *_ = tables(spark)
    dns = spark.createDataFrame([], "frame_number long, query_type int, query_name string")
    tls = spark.createDataFrame([], "frame_number long, version string, sni string")
    for found in (setsketch.standout_days, setsketch.daily_counts, setsketch.day_overlaps, frequent.weekly_heavy_hitters, frequent.top_items):
        assert found(i.limit(0), dns, tls, f).count() == 0 and found(i, dns, tls, f.limit(0)).count() == 0


def test_every_query_with_sql_has_the_same_name():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
