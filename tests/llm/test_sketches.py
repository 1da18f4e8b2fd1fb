from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelake.llm import frequent, radix, setsketch
from wirelake.llm.setsketch import Sketch

SMALL = Sketch(m=256)


def sketch_of(items, s=SMALL):
    r = np.zeros(s.m, np.uint16)
    h = np.random.default_rng(5).permutation(1 << 20)[: 1 << 20]
    del h
    hashed = np.array([hash((i, 17)) for i in items], np.int64)
    setsketch.insert(r, hashed, s)
    return r


@pytest.mark.parametrize("n", [1, 2, 10, 300, 5000, 100_000])
def test_counts_within_the_stated_error(n):
    s = Sketch()
    got = setsketch.estimate(sketch_of(range(n), s), s)
    assert abs(got - n) <= 5 * setsketch.count_error(s) * n + 0.5


def test_merging_is_exact_and_order_free():
    whole = sketch_of(range(3000))
    parts = [sketch_of(range(a, 3000, 7)) for a in range(7)]
    random.Random(1).shuffle(parts)
    assert (np.maximum.reduce(parts) == whole).all() and (np.maximum(whole, whole) == whole).all()
    again = whole.copy()
    setsketch.insert(again, np.array([hash((i, 17)) for i in range(100)], np.int64), SMALL)
    assert (again == whole).all()
    assert setsketch.estimate(np.zeros(256, np.uint16), SMALL) == 0
    for n in (0, 1, 40, 64, 65, 3000):  # hashes or registers: sets merge to the same in any form
        mine, blobs = setsketch.Set(SMALL), []
        for a in range(5):
            part = setsketch.Set(SMALL)
            part.add(np.array([hash((i, 17)) for i in range(a, n, 5)], np.int64))
            blobs.append(part.pack())
        for b in blobs[::-1]:
            mine.merge(setsketch.Set(SMALL, b))
        assert (mine.dense() == sketch_of(range(n))).all() and (mine.registers is None) == (n <= SMALL.few)
        got, error = mine.estimate()
        assert got == n if n <= SMALL.few else abs(got - n) <= 6 * error
        again = setsketch.Set(SMALL, mine.pack())
        assert (again.dense() == mine.dense()).all() and setsketch.compared(again, mine)["jaccard"] == pytest.approx(1 if n else 0, abs=0.01)


@pytest.mark.parametrize("base", [1.001, 1.05, 2.0])
@pytest.mark.parametrize("a,b,both", [(4000, 4000, 2000), (9000, 1000, 900), (500, 500, 0), (2000, 2000, 2000)])
def test_joint_estimates(a, b, both, base):
    s = Sketch(m=2048, b=base, q=65534)
    got = setsketch.joint(sketch_of(range(a), s), sketch_of(range(a - both, a - both + b), s), s)
    true = both / (a + b - both)
    assert abs(got["jaccard"] - true) <= 5 * max(got["error"], 0.004)
    assert abs(got["union"] - (a + b - both)) <= 0.15 * (a + b)


def test_sketches_of_groups(spark):
    rows = [(g, f"i{i}", "x") for g, n in (("a", 50), (None, 400), ("c", 1)) for i in range(n) for _ in range(2)] + [("d", None, "x"), ("a", "", "x")]
    df = spark.createDataFrame(rows, "g string, item string, sketch string").withColumn("__h", F.lit(1))
    got = {r.g: r.estimate for r in setsketch.with_estimate(setsketch.sketches(df, ["g"], F.col("item"), hold_bytes=10)).collect()}
    assert set(got) == {"a", None, "c"} and abs(got["a"] - 51) < 8 and abs(got[None] - 400) < 60 and abs(got["c"] - 1) < 0.2
    assert setsketch.sketches(df.limit(0), ["g"], F.col("item")).count() == 0


def test_many_interleaved_groups_ship_what_they_hold(spark, tmp_path):
    """A row in a group of its own must not cost a whole sketch, whether groups fit the memory or not."""
    df = spark.range(200_000, numPartitions=2).select((F.col("id") % 3000).alias("g"), F.col("id").alias("item"))
    for hold in (setsketch.HOLD_BYTES, 100_000):
        parts = setsketch.partial_sketches(df, ["g"], F.col("item"), hold_bytes=hold)
        assert parts.agg(F.sum(F.length("sketch"))).first()[0] < 5_000_000
        got = setsketch.with_estimate(setsketch.merged(parts, ["g"], Sketch())).select(F.count("*").alias("n"), F.min("estimate").alias("low"), F.max("estimate").alias("high")).first()
        assert got.n == 3000 and got.low == 66 and got.high == 67


def tables(spark):
    """Four weeks of frames, a table without names and one empty."""
    rnd = random.Random(2)
    frames, ipv4 = [], []
    n = 0
    for day in range(14):
        for _ in range(120 if day == 3 else 30):
            n += 1
            frames.append((n, f"2024-01-{day + 1:02d} 10:00:00" if n % 50 else "1970-01-01 00:00:00"))
            ipv4.append((n, rnd.choice([6, 17, None]), n if day == 3 else rnd.randint(1, 40)))
    ipv4 += ipv4[:20] + [(10**6, 6, 5), (None, 6, 5), (5, 6, None)]
    f = spark.createDataFrame(frames, "frame_number long, t string").select("frame_number", F.col("t").cast("timestamp_ntz").alias("ts"))
    return (
        spark.createDataFrame(ipv4, "frame_number long, protocol int, src_ip long"), spark.createDataFrame([(1, 1, "A.b."), (2, None, "."), (3, 1, None)], "frame_number long, query_type int, query_name string"),
        spark.createDataFrame([], "frame_number long, version string, sni string"), f, frames, ipv4,
    )


def test_standout_days_against_brute_force(spark):
    *dfs, frames, ipv4 = tables(spark)
    day = {n: t[:10] for n, t in frames if t > "1971"}
    sets: dict[tuple, set] = {}
    for n, p, src in set(ipv4):
        if n in day and src is not None:
            for g in {"*", str(p)} - {"None"}:
                sets.setdefault((g, day[n]), set()).add(src)
    want = set()
    for (g, d), s in sets.items():
        first = 1 if d <= "2024-01-07" else 8
        week = sorted(len(sets.get((g, f"2024-01-{first + k:02d}"), ())) for k in range(7))
        if len(s) >= 20 and len(s) >= 2 * week[3]:
            want.add(("src_ip", g, d))
    assert {tuple(r) for r in setsketch.standout_days(*dfs).collect()} == want and want
    assert setsketch.daily_counts(*dfs).where("ident = 'query_name'").count() == 4
    for sigmas in (5.0, 1000.0):  # the latter leaves every day with registers to the exact count
        assert {tuple(r) for r in setsketch.standout_days(*dfs, Sketch(m=16), sigmas=sigmas).collect()} == want
    assert setsketch.day_overlaps(*dfs).count() > 5
    assert setsketch.counts_within_error(*dfs).where("NOT within").count() == 0 and setsketch.overlaps_within_error(*dfs).where("NOT within").count() == 0
    # the next day is the next one with rows
    gap = [df.join(dfs[3].where("ts < '2024-01-03' OR ts > '2024-01-06'").select("frame_number").distinct(), "frame_number") for df in dfs[:3]]
    assert {(r.day, r.next_day) for r in setsketch.day_overlaps(*gap, dfs[3]).where("grp = '*' AND ident = 'src_ip'").collect()} >= {("2024-01-02", "2024-01-06")}


@pytest.mark.parametrize("kind,values", [("long", [-5, -5, 0, 3, 2**40, -(2**50), None, 7, 2**63 - 1, -(2**63), 2047, 2048, -2048, -2049, 2**53 - 1, 2**53, 2**53 + 1]), ("int", [5, 4096, 4097, -1, None]), ("double", [-1.5, float("nan"), 0.0, -0.0, 1e-300, 1e300, None, 2.5, float("-inf")])])
def test_radix_quantiles(spark, kind, values):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", None, "b"]), rnd.choice([0, 1, 8, None]), rnd.choice(values)) for _ in range(600)] + [("hot", 1, values[0])] * 300 + [("none", 1, None)]
    df = spark.createDataFrame(rows, f"g string, d int, v {kind}").withColumns({"n": F.lit(0), "kind": F.lit("x"), "__p": F.lit(9)})
    got = radix.radix_quantiles(df, ["g"], "d", {"day": F.col("__p"), "week": F.floor(F.col("__p") / 7).cast("int")}, "v", [(0, 1), (1, 2), (19, 20), (1, 1)])
    groups: dict[tuple, list] = {}
    for g, d, v in rows:
        if d is not None and v is not None:
            groups.setdefault((g, "day", d), []).append(v)
            groups.setdefault((g, "week", d // 7), []).append(v)
    key = lambda v: (1, 0.0) if isinstance(v, float) and math.isnan(v) else (0, v)
    want = {}
    for k, vs in groups.items():
        vs.sort(key=key)
        want[k] = (len(vs), *[vs[max(1, -(-a * len(vs) // b)) - 1] for a, b in ((0, 1), (1, 2), (19, 20), (1, 1))])
    found = {(r.g, r.kind, r.win): tuple(r)[3:] for r in got.collect()}
    assert repr(sorted(found.items(), key=repr)).replace("-0.0", "0.0") == repr(sorted(want.items(), key=repr)).replace("-0.0", "0.0")
    assert radix.radix_quantiles(df.limit(0), ["g"], "d", {"day": F.col("__p")}, "v", [(1, 2)]).count() == 0


def test_saved_days_merge_into_weeks(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", None]), d, int(rnd.lognormvariate(9, 3)) * rnd.choice((1, 1, -1)), rnd.lognormvariate(0, 9)) for d in range(2) for _ in range(3000)] + [("a", 0, None, None)]
    df = spark.createDataFrame(rows, "g string, day int, v long, f double").withColumns({"digit": F.lit(1), "n": F.lit(2)})
    for value, at in (("v", 2), ("f", 3)):
        for d in range(2):
            radix.digit_histograms(df.where(F.col("day") == d), ["g"], value).write.mode("overwrite").parquet(f"{tmp_path}/{value}{d}")
        both = spark.read.parquet(f"{tmp_path}/{value}0").unionByName(spark.read.parquet(f"{tmp_path}/{value}1"))
        for r in radix.histogram_quantiles(both, ["g"], [(1, 2), (19, 20), (1, 1)], value == "f").collect():
            vs = sorted(x[at] for x in rows if x[0] == r.g and x[at] is not None)
            assert r.n == len(vs)
            for i, (a, b) in enumerate(((1, 2), (19, 20), (1, 1))):
                true, low, high = vs[-(-a * len(vs) // b) - 1], r[f"q{i}_low"], r[f"q{i}_high"]
                assert low <= true <= high and high - low <= max(abs(low), abs(high)) * 2**-radix.FRACTION


def test_conservative_update_never_underestimates():
    rnd = np.random.default_rng(7)
    sketch, true = np.zeros((4, 64), np.int64), Counter()
    for _ in range(50):
        h = np.unique(rnd.zipf(1.3, 200).astype(np.int64) % 5000)
        n = rnd.integers(1, 9, len(h))
        now = frequent.conservative_add(sketch, h, n)
        for x, c, e in zip(h.tolist(), n.tolist(), now.tolist(), strict=True):
            true[x] += c
            assert e >= true[x]
    h = np.array(sorted(true), np.int64)
    at = frequent.cells(h, 64, 4)
    assert (sketch[np.arange(4)[:, None], at].min(axis=0) >= np.array([true[x] for x in h.tolist()])).all()


def test_frequent_items(spark):
    rnd = random.Random(8)
    rows = [(None if i % 5 == 0 else "g", "hot" if rnd.random() < 0.35 else f"r{rnd.randint(0, 3000)}") for i in range(9000)] + [("g", None), ("h", ""), ("h", "")]
    df = spark.createDataFrame(rows, "grp string, item string").withColumns({"n": F.lit(1), "estimate": F.lit(1), "g": F.lit("x")})
    got = frequent.frequent_items(df, ["grp"], "item", top=20).collect()
    true = Counter(r for r in rows if r[1] is not None)
    assert all(r.estimate >= true[r.grp, r.item] for r in got) and len({(r.grp, r.item) for r in got}) == len(got)
    for g in ("g", None):
        best = max((r for r in got if r.grp == g), key=lambda r: r.estimate)
        assert best.item == "hot" and best.estimate - true[g, "hot"] <= 0.01 * len(rows)
    assert ("h", "", 2) in {(r.grp, r.item, r.estimate) for r in got}
    assert frequent.frequent_items(df.limit(0), ["grp"], "item").count() == 0


def test_weekly_heavy_hitters(spark):
    *dfs, frames, ipv4 = tables(spark)
    day = {n: t for n, t in frames if t > "1971"}
    count: Counter = Counter()
    for n, _, src in set(ipv4):
        if n in day and src is not None:
            count["2024-01-01" if day[n] < "2024-01-08" else "2024-01-08", src] += 1
    total = Counter()
    for (w, _), c in count.items():
        total[w] += c
    want = {("src_ip", w, str(s)) for (w, s), c in count.items() if c >= 10 and c * 100 >= total[w]}
    assert {tuple(r) for r in frequent.weekly_heavy_hitters(*dfs).collect()} == want
    assert frequent.top_items(*dfs, k=3).count() == 2 * 3 + 1
