"""Exact quantiles by radix selection over mergeable digit histograms.

A value becomes a 64-bit integer of the same order. The first digit of an integer is its bit length
and the ``FRACTION`` bits below the leading one, so that one pass finds every quantile to a relative
width of ``2 ** -FRACTION`` whatever the range; for floating values sign, exponent and the leading
bits of the fraction do the same. Each further pass histograms the next ``DIGIT`` bits, of only those
rows that share the prefix of a wanted rank, picks the digit the rank falls into and descends; after
the last digit the prefix is the quantile itself, so the error is zero.

Histograms are made from the rows by partial aggregation, so a hot group costs a split one row a
digit. Histograms of days add up to those of weeks, in the operator and when they are saved:
:func:`digit_histograms` gives the state of the first pass, and :func:`histogram_quantiles` reads
quantiles with bounds of their error from any sum of such states.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.operators.capture import day_text, once, week_of, with_day
from wirelake.session import cut, kept, small_side

#: Bits of the first digit below the leading one, and of every further digit.
FRACTION, DIGIT = 10, 16
#: Bits of a floating value's key that follow sign, exponent and ``FRACTION`` bits.
_FLOATING_REST = 52 - FRACTION
_REST = 2**63 - 1
_NAN = int(np.array([np.nan]).view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _double_order(v: pd.Series) -> pd.Series:
    x = v.to_numpy(np.float64, na_value=np.nan)
    bits = np.where(np.isnan(x), np.nan, np.where(x == 0, 0.0, x)).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(_REST), bits))


@F.pandas_udf(T.DoubleType())
def _double_back(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(_REST), bits).view(np.float64))


def ordered_key(value: Column, kind: T.DataType) -> Column:
    """A long in the order of ``value``; -0.0 equals 0.0 and NaN is the greatest."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value.isNotNull(), _double_order(value.cast("double")))
    return value.cast("long")


def _mask(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1


def _bits(key: Column, floating: bool) -> Column:
    """Bits of a key that follow its first digit."""
    if floating:
        return F.lit(_FLOATING_REST)
    # the bit length of the number or, if it is negative, of its complement
    size = key.bitwiseXOR(F.shiftright(key, 63))
    return F.greatest(F.length(F.bin(size)) - (FRACTION + 1), F.lit(0))


def _first_digit(key: Column, floating: bool) -> Column:
    """The first digit of an ordered key, in the order of the keys."""
    if floating:
        return F.shiftright(key, _FLOATING_REST)
    sign, left = F.shiftright(key, 63), _bits(key, False)
    digit = F.shiftleft(left.cast("long"), FRACTION + 1) + F.call_function("shiftright", key.bitwiseXOR(sign), left)
    return digit.bitwiseXOR(sign)


def _bits_left(digit: Column, floating: bool) -> Column:
    """Bits that follow a first digit."""
    if floating:
        return F.lit(_FLOATING_REST)
    return F.shiftright(digit.bitwiseXOR(F.shiftright(digit, 63)), FRACTION + 1).cast("int")


def _lowest(digit: Column, floating: bool) -> Column:
    """The lowest key of a first digit."""
    if floating:
        return F.shiftleft(digit, _FLOATING_REST)
    sign, left = F.shiftright(digit, 63), _bits_left(digit, False)
    low = F.call_function("shiftleft", digit.bitwiseXOR(sign).bitwiseAND(F.lit(2 ** (FRACTION + 1) - 1)), left)
    return low.bitwiseOR(_mask(left).bitwiseAND(sign)).bitwiseXOR(sign)


def _back(key: Column, floating: bool) -> Column:
    """The value of a key; pandas would turn NaN into NULL on the way."""
    return F.when(key == _NAN, F.lit(float("nan"))).otherwise(_double_back(key)) if floating else key


def _is_floating(df: DataFrame, value: str) -> bool:
    return isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType))


def digit_histograms(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """State of the first pass: ``group..., digit long, n long``, the values of each group by their first
    digit. States of other rows add up: union them and sum ``n``, for example days into weeks.

    NULL values do not count; NULL group values form groups.
    """
    key = ordered_key(F.col(f"`{value}`"), df.schema[value].dataType)
    rows = df.where(F.col(f"`{value}`").isNotNull()).select(*[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group)], key.alias("__k"))
    names = [f"__g{i}" for i in range(len(group))]
    hist = rows.groupBy(*names, _first_digit(F.col("__k"), _is_floating(df, value)).alias("digit")).agg(F.count("*").alias("n"))
    return hist.select(*[F.col(a).alias(g) for a, g in zip(names, group, strict=True)], "digit", "n")


def histogram_quantiles(states: DataFrame, group: list[str], quantiles: list[tuple[int, int]], floating: bool = False) -> DataFrame:
    """Quantiles of each group from states of :func:`digit_histograms`, which may have any number of
    rows a digit and further columns: ``group..., n``, and for every quantile ``q0_low, q0_high``, two
    values at most a part ``2 ** -FRACTION`` of them apart between which the exact quantile lies."""
    names = [f"__g{i}" for i in range(len(group))]
    hist = states.groupBy(*[F.col(f"`{g}`").alias(a) for g, a in zip(group, names, strict=True)], F.col("digit").alias("__d")).agg(F.sum("n").alias("__c"))
    found = _picked(hist, names, "__d", quantiles)
    low = _lowest(F.col("__d"), floating)
    found = found.select("*", _back(low, floating).alias("__low"), _back(low + _mask(_bits_left(F.col("__d"), floating)), floating).alias("__high"))
    ends = [F.max(F.when(F.col("i") == i, F.col(c))).alias(f"q{i}{c[1:]}") for i in range(len(quantiles)) for c in ("__low", "__high")]
    wide = found.groupBy(*names).agg(F.max("n").alias("n"), *ends)
    return wide.select(*[F.col(a).alias(g) for a, g in zip(names, group, strict=True)], *wide.columns[len(names) :])


def _picked(hist: DataFrame, by: list[str], digit: str, quantiles: list[tuple[int, int]]) -> DataFrame:
    """For every quantile the digit that its rank falls into, and the rank within it."""
    every = Window.partitionBy(*by)
    up_to = F.sum("__c").over(every.orderBy(digit).rowsBetween(Window.unboundedPreceding, 0))
    q = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(quantiles)])
    ranked = hist.select("*", F.sum("__c").over(every).alias("n"), up_to.alias("__upto")).select("*", F.inline(q))
    ranked = ranked.withColumn("rank", F.greatest(F.expr("(n * a + b - 1) div b"), F.lit(1).cast("long")))
    return _in_digit(ranked)


def _in_digit(ranked: DataFrame) -> DataFrame:
    before = F.col("__upto") - F.col("__c")
    return ranked.where((F.col("rank") > before) & (F.col("rank") <= F.col("__upto"))).withColumn("rank", F.col("rank") - before)


def radix_quantiles(df: DataFrame, group: list[str], part: str, rollups: dict[str, Column], value: str, quantiles: list[tuple[int, int]], digit_bits: int = DIGIT) -> DataFrame:
    """Quantiles of ``value`` per ``group`` and window.

    ``part`` is the finest window (such as a day) and ``rollups`` maps the name of every window kind
    to the expression that names the window, written over the column ``__p``, which is the part.
    ``quantiles`` are fractions (numerator, denominator); the quantile of a share is the smallest
    value such that at least that share of the values is at most it. Result: ``group..., kind
    string, win, n long, q0, q1, ...`` (long, or double for floating values).

    ``df`` is read once a pass, one pass more than the values have digits below the first where ranks
    fall; it should be a table, or written out by ``session.kept`` if it is dear to compute.

    * NULL values and rows with a NULL ``part`` do not count; NULL group values form groups; ties and
      repeated rows count as often as given; an empty table gives an empty result; other columns,
      whatever their names, are ignored.
    """
    floating = _is_floating(df, value)
    names = [f"__g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(f"`{g}`").alias(a) for g, a in zip(group, names, strict=True)], F.col(f"`{part}`").alias("__p"), F.col(f"`{value}`").alias("__v")).where("__p IS NOT NULL AND __v IS NOT NULL")
    windows = F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("win")) for k, e in rollups.items()])
    by = [*names, "kind", "win"]
    # the first pass: one row a group, part and digit
    states = cut(digit_histograms(rows, [*names, "__p"], "__v"))
    hist = states.select(*names, "digit", "n", F.inline(windows)).groupBy(*by, F.col("digit").alias("__d")).agg(F.sum("n").alias("__c"))
    digit = F.col("__d")
    targets = _picked(hist, by, "__d", quantiles).select(*by, "n", "i", "rank", _lowest(digit, floating).alias("low"), _bits_left(digit, floating).alias("left"))
    targets = cut(targets)
    done = targets.where("left = 0")
    parts = states.select(*names, "__p").distinct().select(*names, "__p", F.inline(windows))
    most = targets.agg(F.max("left")).first()[0] or 0
    key = ordered_key(F.col("__v"), rows.schema["__v"].dataType)
    for step in range(-(-most // digit_bits)):
        # the rows' bits left after the digits taken, and the digit that follows
        keyed = rows.select(*names, "__p", key.alias("__k"))
        keyed = keyed.withColumn("__left", F.greatest(_bits(F.col("__k"), floating) - step * digit_bits, F.lit(0)))
        rest = F.col("__k").bitwiseAND(_mask(F.col("__left")))
        width = F.greatest(F.col("__left") - digit_bits, F.lit(0))
        keyed = keyed.where("__left > 0").select(*names, "__p", (F.col("__k") - rest).alias("__low"), F.call_function("shiftright", rest, width).alias("__digit"))
        # a few prefixes a group and part are left; broadcast, so that a hot group stays where it is
        open_ = targets.where("left > 0")
        wanted = small_side(cut(_joined(open_, parts, by).select(*[F.col(a).alias(f"__w{i}") for i, a in enumerate([*names, "__p", "low"])]).distinct()))
        same = [F.col(a).eqNullSafe(F.col(f"__w{i}")) for i, a in enumerate([*names, "__p", "__low"])]
        found = keyed.join(wanted, _all(same), "left_semi").groupBy(*names, "__p", "__low", "__digit").agg(F.count("*").alias("__c"))
        hist = found.select(*names, "__low", "__digit", "__c", F.inline(windows)).groupBy(*by, F.col("__low").alias("low"), "__digit").agg(F.sum("__c").alias("__c"))
        # at most 2^digit_bits digits below one prefix, so the running sum is bounded
        upto = F.sum("__c").over(Window.partitionBy(*by, "low").orderBy("__digit").rowsBetween(Window.unboundedPreceding, 0))
        found = _in_digit(_joined(open_, hist.withColumn("__upto", upto), [*by, "low"]))
        width = F.greatest(F.col("left") - digit_bits, F.lit(0))
        targets = cut(found.select(*by, "n", "i", "rank", (F.col("low") + F.call_function("shiftleft", F.col("__digit"), width)).alias("low"), width.alias("left")))
        done = done.unionByName(targets.where("left = 0"))
    found = done.withColumn("__q", _back(F.col("low"), floating))
    wide = found.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("__q"))).alias(f"q{i}") for i in range(len(quantiles))])
    return wide.select(*[F.col(a).alias(g) for a, g in zip(names, group, strict=True)], "kind", "win", "n", *[f"q{i}" for i in range(len(quantiles))])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which NULLs meet; the columns of ``on`` once."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    return left.join(other, _all([F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])).drop(*[f"__r_{c}" for c in on])


def measured(ipv4: DataFrame, http2: DataFrame, frames: DataFrame) -> DataFrame:
    """``metric, grp, day, value``: packet lengths by protocol, response sizes by authority."""
    sizes = once(ipv4, "frame_number", grp=F.col("protocol").cast("string"), value=F.col("total_length").cast("long")).where("value IS NOT NULL")
    host = F.regexp_replace(F.lower("authority"), ":443$", "")
    bodies = once(http2, "request_frame", grp=host, value=F.col("response_body_len")).where("value IS NOT NULL AND grp IS NOT NULL")
    sizes = with_day(sizes.withColumn("metric", F.lit("total_length")), frames)
    bodies = with_day(bodies.withColumn("metric", F.lit("response_body_len")), frames)
    return sizes.unionByName(bodies).where(F.col("grp").isNotNull())


def day_and_week_quantiles(ipv4: DataFrame, http2: DataFrame, frames: DataFrame) -> DataFrame:
    """``metric, grp, win, n, p50, p95`` of every day and week that has values."""
    found = radix_quantiles(kept(measured(ipv4, http2, frames)), ["metric", "grp"], "day", {"day": F.col("__p"), "week": week_of(F.col("__p"))}, "value", [(1, 2), (19, 20)])
    return found.select("metric", "grp", F.concat_ws(" ", "kind", day_text(F.col("win"))).alias("win"), "n", F.col("q0").alias("p50"), F.col("q1").alias("p95"))


def long_tails(ipv4: DataFrame, http2: DataFrame, frames: DataFrame, least: int = 30, factor: int = 8) -> DataFrame:
    """Windows with at least ``least`` values whose 95 % quantile is ``factor`` times a positive
    median: ``metric, grp, win``."""
    return day_and_week_quantiles(ipv4, http2, frames).where((F.col("n") >= least) & (F.col("p50") > 0) & (F.col("p95") >= factor * F.col("p50"))).select("metric", "grp", "win")
