"""High dynamic range histograms with two significant figures, as maps of bucket to count.

A bucket is named by its low edge: values below 256 have buckets of their own, and above that every
power of two is cut into 128 equal ones. The aggregate is a plain two-level grouping (bucket counts,
then the map of a group's buckets), so it combines on the map side, has at most some 7,000
buckets a group, and histograms of splits, days or files merge by adding counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(value: Column) -> Column:
    """Low edge of the bucket of a value; NULL for NULL and negative values; fractions are cut off."""
    v = value.cast("long")
    k = F.greatest(F.length(F.bin(v)) - 8, F.lit(0))
    return F.when(v >= 0, F.call_function("shiftleft", F.call_function("shiftright", v, k), k))


def histograms(df: DataFrame, group: list[str], value: str, alias: str = "h") -> DataFrame:
    """``group..., alias map<bigint,bigint>``: the histogram of each group; groups without a
    countable value have an empty one. Only the named columns are read."""
    names = [f"__g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(f"`{g}`").alias(a) for g, a in zip(group, names, strict=True)], bucket(F.col(f"`{value}`")).alias("__b"))
    counts = rows.groupBy(*names, "__b").agg(F.count("*").alias("__n"))
    entry = F.when(F.col("__b").isNotNull(), F.struct("__b", "__n"))
    return counts.groupBy(*names).agg(F.map_from_entries(F.collect_list(entry)).alias(alias)).select(*[F.col(a).alias(g) for g, a in zip(group, names, strict=True)], alias)


def merge(df: DataFrame, group: list[str], h: str = "h") -> DataFrame:
    """Histograms of coarser groups from those of finer ones."""
    flat = df.select(*[F.col(f"`{g}`") for g in group], F.explode(F.col(f"`{h}`")).alias("__b", "__n"))
    counts = flat.groupBy(*group, "__b").agg(F.sum("__n").alias("__n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("__b", "__n"))).alias(h))
