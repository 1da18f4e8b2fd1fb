"""Common reading rules of the capture tables: repeated rows, frame days, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows dated before this had no time in their capture block.
FIRST_REAL = "1971-01-01 00:00:00"


def _wanted(df: DataFrame, key: str, wanted: dict[str, Column]) -> DataFrame:
    names = [F.col(f"`{c}`") for c in df.columns]
    # the hash skips NULLs, so which columns are NULL goes into it as well
    row = F.xxhash64(*names, *[c.isNull() for c in names])
    return df.select(F.col(f"`{key}`").alias("__key"), row.alias("__row"), *[c.alias(n) for n, c in wanted.items()])


def once(df: DataFrame, key: str, **wanted: Column) -> DataFrame:
    """``wanted`` columns of ``df`` with rows repeated in *all* columns of ``df`` kept once; rows with a
    NULL ``key`` go.

    The row is shuffled as its wanted columns plus a 64-bit hash of all columns, partitioned by
    ``key`` alone, so a later join or grouping on ``key`` needs no second exchange. NULLs equal
    NULLs. Two rows merge only if the key, the wanted columns and the hash agree. Columns named
    ``__row`` in the input are safe: the input's names are only read, never kept.
    """
    return _wanted(df, key, wanted).where("__key IS NOT NULL").repartition("__key").dropDuplicates().drop("__row")


def once_without_key(df: DataFrame, key: str, **wanted: Column) -> DataFrame:
    """The rows that :func:`once` leaves out. They share no key, so they are spread by their contents."""
    return _wanted(df, key, wanted).where("__key IS NULL").dropDuplicates().drop("__row")


def frame_days(frames: DataFrame) -> DataFrame:
    """(frame_number, day) of every frame with a real time; day is the number of days since 1970.

    Frames without number or time, and frames dated 1970, give no row.
    """
    return (
        frames.where(F.col("frame_number").isNotNull() & (F.col("ts") >= F.lit(FIRST_REAL).cast("timestamp_ntz")))
        .select(F.col("frame_number").alias("__frame"), F.unix_date(F.col("ts").cast("date")).alias("day"))
        .repartition("__frame")
        .dropDuplicates()
    )


def with_day(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """``rows`` (of :func:`once`, keyed by frame number) with their day; rows of no day go."""
    days = frame_days(frames)
    return rows.join(days, rows["__key"] == days["__frame"]).drop("__key", "__frame")


def day_text(day: Column) -> Column:
    """Day number as ``YYYY-MM-DD``."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")


def week_of(day: Column) -> Column:
    """Day number of the Monday of a day's week (day 0, a Thursday, is three days after one)."""
    return day - F.pmod(day + F.lit(3), F.lit(7))


def plain_name(name: Column) -> Column:
    """Lower case without trailing dots; NULL where nothing is left."""
    name = F.lower(F.rtrim(name, F.lit(".")))
    return F.when(name != "", name)
