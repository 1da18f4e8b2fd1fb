"""The general problems on small tables with every kind of dirt, against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wirelake.operators.dense import heavy_sources
from wirelake.operators.sessions import segment_sessions

IPV4 = "frame_number long, encap_depth int, src_ip long, total_length int, day string, __key long"
FRAMES = "frame_number long, t string, day string"
SEGMENTS = "connection_id long, frame_number long, t string, entity string"


def timed(df):
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")


def test_heavy_sources(spark):
    rnd = random.Random(1)
    frames = [(n, rnd.choice(["2024-01-01 10:00:00", "2024-01-02 23:59:59.999999", "1970-01-01 00:00:00", None]), "x") for n in range(1, 600)] + [(None, "2024-01-01 00:00:00", "x")]
    ipv4 = [(rnd.choice([*range(1, 650), None]), 0, rnd.choice([None, 7, 7, 7, *range(10, 40)]), rnd.choice([None, 1, 5, 9]), None, 1) for _ in range(3000)]
    ipv4 += ipv4[:300]
    day = {n: t[:10] for n, t, _ in frames if n and t and t > "1971"}
    rows = [(day[r[0]], r[2], r[3], r[0]) for r in set(ipv4) if r[0] in day]
    total, per = {}, {}
    for d, s, v, n in rows:
        total[d] = total.get(d, 0) + 1
        if s is not None:
            per.setdefault((d, s), []).append((v, n))
    want = set()
    for (d, s), got in per.items():
        if len(got) >= 20 and len(got) * 50 >= total[d]:
            top = max((v for v, _ in got if v is not None), default=None)
            want.add((d, s, min((n for v, n in got if v == top and v is not None), default=None)))
    f, i = timed(spark.createDataFrame(frames + frames[:50], FRAMES)), spark.createDataFrame(ipv4, IPV4)
    assert {tuple(r) for r in heavy_sources(i, f).collect()} == want and want
    assert heavy_sources(i.limit(0), f).count() == 0 and heavy_sources(i, f.limit(0)).count() == 0


def test_segment_sessions(spark):
    rnd = random.Random(2)
    segments = [(rnd.choice([None, 1, 1, 2, 3]), n if rnd.random() < 0.97 else None, rnd.choice([None, "1970-01-01 00:00:01", *[f"2024-01-01 {h:02d}:{m:02d}:00" for h in range(3) for m in range(0, 60, 5)]]), "x") for n in range(300)]
    segments += segments[:40]
    ipv4 = [(n, d, rnd.choice([None, 50, 51]), None, None, None) for n in range(0, 300, 2) for d in range(rnd.randint(1, 3))] + [(4, None, 99, None, None, None), (None, 0, 50, None, None, None)]
    deepest = {}
    for n, d, s, *_ in ipv4:
        if n is not None and (n not in deepest or (d if d is not None else -1) > deepest[n][0]):
            deepest[n] = (d if d is not None else -1, s)
    events = {}
    for c, n, t, _ in set(segments):
        if t is None or t < "1971":
            continue
        us = (int(t[11:13]) * 3600 + int(t[14:16]) * 60) * 1_000_000 + 1_704_067_200_000_000
        for e, i in (("connection", c), ("src_ip", deepest.get(n, (0, None))[1])):
            if i is not None:
                events.setdefault((e, i), []).append(us)
    want = set()
    for (e, i), ts in events.items():
        ts.sort()
        start = 0
        for k in range(1, len(ts) + 1):
            if k == len(ts) or ts[k] - ts[k - 1] > 300_000_000:
                want.add((e, i, ts[start], ts[k - 1], k - start))
                start = k
    s, i = timed(spark.createDataFrame(segments, SEGMENTS)), spark.createDataFrame(ipv4, IPV4)
    assert {tuple(r) for r in segment_sessions(s, i).collect()} == want
    assert segment_sessions(s.limit(0), i).count() == 0
    assert {r.entity for r in segment_sessions(s, i.limit(0)).collect()} == {"connection"}
