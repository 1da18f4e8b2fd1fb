"""Structured Streaming over a folder that captures arrive in.

Files are read whole as they appear, decoded on the executors, and flow into windowed counts, sessions
and connection states with watermarks on the capture time.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirelake.sources import container, datasource
from wirelake.streaming import analysis
from wirelake.streaming.tcp import ENDED, IDLE_US, next_state

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def live_frames(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A stream of the frames of every capture file that appears in a folder; numbered per file."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).options(**options).load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = container.records(container.opened(io.BufferedReader(io.BytesIO(content.as_py()))))
                rows = []
                for number, (us, wire, link, data) in enumerate(source, 1):
                    rows.append((number, us, len(data), wire, link, data, path))
                    if len(rows) == datasource.BATCH:
                        yield datasource._batch(rows)
                        rows = []
                if rows:
                    yield datasource._batch(rows)

    frames = files.select("path", "content").mapInArrow(read, datasource.SCHEMA)
    # watermarks want an instant
    return frames.withColumn("event_time", F.col("timestamp").cast("timestamp"))


def window_counts(rows: DataFrame, keys: list[str | Column], length: str, slide: str | None = None, late: str = "10 minutes", weight: str = "original_length") -> DataFrame:
    """Rows and bytes per key and tumbling or sliding window; rows later than ``late`` are left out."""
    window = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    return rows.withWatermark("event_time", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")).select("w.start", "w.end", *keys, "n", "bytes")


def session_counts(rows: DataFrame, keys: list[str], gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that end after ``gap`` without a row. A row at exactly the gap begins a new
    session here, by the definition of Spark's session windows."""
    return rows.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("s"), *keys).agg(F.count("*").alias("n")).select("s.start", "s.end", *keys, "n")


_OUT = "conn string, state string, segments long, bytes long, first_us long, last_us long, is_complete boolean"
_STATE = "state string, client_is_a boolean, segments long, bytes long, first_us long, last_us long"


def connection_states(frames: DataFrame, late: str = "10 minutes", idle_us: int = IDLE_US) -> DataFrame:
    """A stream of finished connections: those without a segment for ``idle_us`` of capture time, in
    whatever state, and ended ones whose ports open anew.

    Only counters are kept between batches, a few dozen bytes a connection. The segments of a batch
    are taken in the order of their times.
    """
    rows = analysis.segments(frames).where("ts IS NOT NULL").withColumn("event_time", F.timestamp_micros("ts")).select("conn", "event_time", "ts", "forward", "a_port", "b_port", "flags", F.length("payload").alias("size"))

    def follow(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple[Any, ...]] = []

        def finish(s: tuple[Any, ...]) -> None:
            done.append((key[0], s[0], s[2], s[3], s[4], s[5], s[0] in ENDED))

        if state.hasTimedOut:
            finish(state.get)
            state.remove()
        else:
            now = state.get if state.exists else None
            # a batch of one connection is as large as its share of one trigger's files
            for r in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
                opening = bool(r.flags & 2) and not r.flags & 16
                # an ended connection waits for stragglers until it is idle or its ports open anew
                if now is not None and (r.ts - now[5] > idle_us or (opening and now[0] in ENDED)):
                    finish(now)
                    now = None
                if now is None:
                    now = ("syn_sent" if opening else "mid_stream", bool(r.forward) if opening else bool(r.a_port > r.b_port), 0, 0, int(r.ts), int(r.ts))
                now = (next_state(now[0], int(r.flags), bool(r.forward) == now[1]), now[1], now[2] + 1, now[3] + int(r.size), now[4], int(r.ts))
            if now is not None:
                state.update(now)
                state.setTimeoutTimestamp(max(now[5] // 1000 + idle_us // 1000, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=["conn", "state", "segments", "bytes", "first_us", "last_us", "is_complete"])

    return rows.withWatermark("event_time", late).groupBy("conn").applyInPandasWithState(follow, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
