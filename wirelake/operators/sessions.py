"""Sessions by start-end pairing.

An event starts a session if no other event of its entity lies within the gap before it, and ends
one if none lies within the gap after it; both are RANGE frames, neither needs a running state.
The k-th start and the k-th end of an entity belong to the same session, so starts and ends are
numbered separately and joined on the rank; the difference of the running event counts at both is
the number of events in between.

A window over a whole entity would put an entity with a third of all events into one task. So time
is cut into chunks, events near a border are copied into the neighbour chunk as context, frames run
per (entity, chunk), and the ranks and running counts of the chunks are lifted to the entity by
prefix sums over one row per (entity, chunk).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.operators.capture import FIRST_REAL, once, once_without_key
from wirelake.session import cut

#: A session ends after this many microseconds without an event.
GAP_US = 300_000_000
#: Length of the chunks of time in microseconds; at least the gap.
CHUNK_US = 3_600_000_000


def pair_sessions(events: DataFrame, keys: list[str], ts_us: str, gap_us: int = GAP_US, chunk_us: int = CHUNK_US, weight: str | None = None) -> DataFrame:
    """Sessions of each entity: ``keys..., start_us long, end_us long, n_events long``.

    ``ts_us`` is an integer column of microseconds. An event more than ``gap_us`` after the
    previous one of its entity starts a new session; exactly ``gap_us`` does not. ``weight`` is an
    integer column of how many events a row stands for, 1 without it.

    * Rows with a NULL key or NULL time belong to no session; events at the same time, repeated rows
      among them, are one point in time and all count.
    * Negative times are fine; an empty table gives an empty result; an entity with one event
      has a session of zero length; other columns, whatever their names, are ignored.
    """
    chunk_us = max(chunk_us, gap_us + 1)
    names = [f"__k{i}" for i in range(len(keys))]
    n = F.col(f"`{weight}`") if weight else F.lit(1)
    points = events.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, names, strict=True)], F.col(f"`{ts_us}`").cast("long").alias("__t"), n.cast("long").alias("__n")).dropna(subset=[*names, "__t"])
    # many events at one microsecond, and repeated ones, shrink to one row before the shuffle
    points = points.groupBy(*names, "__t").agg(F.sum("__n").alias("__n"))
    chunk = F.expr(f"(__t - pmod(__t, {chunk_us}L)) div {chunk_us}L")
    into = F.pmod("__t", F.lit(chunk_us))
    copies = F.array_compact(
        F.array(
            F.struct(chunk.alias("c"), F.lit(True).alias("own")),
            F.when(into <= gap_us, F.struct((chunk - 1).alias("c"), F.lit(False).alias("own"))),
            F.when(into >= chunk_us - gap_us, F.struct((chunk + 1).alias("c"), F.lit(False).alias("own"))),
        )
    )
    spread = points.select(*names, "__t", "__n", F.inline(copies).alias("__c", "__own"))
    by = Window.partitionBy(*names, "__c").orderBy("__t")
    own_n = F.when(F.col("__own"), F.col("__n")).otherwise(0)
    marked = spread.select(
        *names, "__c", "__t", "__n", "__own",
        (F.count("*").over(by.rangeBetween(-gap_us, -1)) == 0).alias("__starts"),
        (F.count("*").over(by.rangeBetween(1, gap_us)) == 0).alias("__ends"),
        F.sum(own_n).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("__seen"),
        (F.max(F.when(F.col("__own"), F.col("__t"))).over(Window.partitionBy(*names, "__c")) == F.col("__t")).alias("__last"),
    ).where("__own AND (__starts OR __ends OR __last)")
    ranks = [F.sum(F.col(c).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(a) for c, a in (("__starts", "__sr"), ("__ends", "__er"))]
    marks = cut(marked.select(*names, "__c", "__t", "__n", "__starts", "__ends", "__last", "__seen", *ranks))
    # the last event of a chunk, start or end or neither, has the counts of the whole chunk
    sums = marks.where("__last").select(*names, "__c", F.col("__sr").alias("__ss"), F.col("__er").alias("__es"), F.col("__seen").alias("__sn"))
    over = Window.partitionBy(*names).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*names, "__c", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}0") for c in ("__ss", "__es", "__sn")])
    lifted = marks.join(base, [*names, "__c"])
    starts = lifted.where("__starts").select(*names, (F.col("__sr") + F.col("__ss0")).alias("__rank"), F.col("__t").alias("start_us"), (F.col("__seen") + F.col("__sn0") - F.col("__n")).alias("__before"))
    ends = lifted.where("__ends").select(*names, (F.col("__er") + F.col("__es0")).alias("__rank"), F.col("__t").alias("end_us"), (F.col("__seen") + F.col("__sn0")).alias("__through"))
    return starts.join(ends, [*names, "__rank"]).select(*[F.col(a).alias(k) for a, k in zip(names, keys, strict=True)], "start_us", "end_us", (F.col("__through") - F.col("__before")).alias("n_events"))


def segment_entities(segments: DataFrame, ipv4: DataFrame) -> DataFrame:
    """One row per segment and entity: ``entity string, entity_id long, ts_us long``.

    A segment belongs to its connection and to the source address of its frame's ipv4 row of
    greatest encap_depth; NULL ids and segments dated 1970 or without time give no row.
    """
    wanted = {"conn": F.col("connection_id"), "ts": F.col("ts")}

    def real(df: DataFrame) -> DataFrame:
        return df.where(F.col("ts") >= F.lit(FIRST_REAL).cast("timestamp_ntz")).select("__key", "conn", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))

    seg = real(once(segments, "frame_number", **wanted))
    # depth and address packed into one number, whose greatest needs no sorting; 0 stands for NULL
    packed = F.shiftleft(F.coalesce(F.col("encap_depth").cast("long") + 1, F.lit(0)), 34).bitwiseOR(F.coalesce(F.col("src_ip") + 1, F.lit(0)))
    deepest = ipv4.where(F.col("frame_number").isNotNull()).groupBy(F.col("frame_number").alias("__frame")).agg(F.max(packed).alias("packed"))
    deepest = deepest.select("__frame", (F.nullif(F.col("packed").bitwiseAND(F.lit((1 << 34) - 1)), F.lit(0)) - 1).alias("src"))
    both = seg.join(deepest, seg["__key"] == deepest["__frame"], "left")
    pair = F.array(F.struct(F.lit("connection").alias("entity"), F.col("conn").alias("id")), F.struct(F.lit("src_ip").alias("entity"), F.col("src").alias("id")))
    found = both.select(F.inline(pair).alias("entity", "entity_id"), "ts_us")
    # a segment without a frame number still belongs to its connection
    loose = real(once_without_key(segments, "frame_number", **wanted)).select(F.lit("connection").alias("entity"), F.col("conn").alias("entity_id"), "ts_us")
    return found.unionByName(loose).where(F.col("entity_id").isNotNull())


def segment_sessions(segments: DataFrame, ipv4: DataFrame) -> DataFrame:
    """Sessions of every connection and source address, by :func:`pair_sessions`."""
    return pair_sessions(segment_entities(segments, ipv4), ["entity", "entity_id"], "ts_us").withColumnRenamed("n_events", "n_segments")
