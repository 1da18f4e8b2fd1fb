"""Grouped counts and extremes through dense accumulator arrays, immune to hot keys.

Every input split encodes its keys with a local dictionary (key -> dense code) and scatter-reduces
its rows into flat numpy arrays indexed by code: ``bincount`` for counts, ``maximum.at`` and
``minimum.at`` for extremes. What leaves a split is one array block per hash range of keys, so a key
that holds a third of all rows costs each split exactly one array slot. Blocks of one range then
meet in one task, which adds them up in a stream, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.operators.capture import day_text, once, with_day
from wirelake.session import cut, shuffle_width, small_side

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Distinct keys a split holds before it emits its blocks and starts anew.
FLUSH_KEYS = 500_000
#: Rows, or array slots, that wait before they are added to the accumulator at once.
HOLD_ROWS = 100_000


class _Accumulator:
    """Dictionary and accumulator arrays of two integer key columns; NULL keys are keys."""

    def __init__(self) -> None:
        self.keys = np.empty(0, dtype=[("a", "i8"), ("b", "i8"), ("null", "i1")])
        self.n = np.empty(0, np.int64)
        self.top = np.empty(0, np.int64)
        self.tie = np.empty(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray, top: np.ndarray, tie: np.ndarray) -> None:
        keys, n, top, tie = (np.concatenate(x) for x in ((self.keys, keys), (self.n, n), (self.top, top), (self.tie, tie)))
        # one sort by the packed key stands for the dictionary; codes are its dense ranks
        order = np.lexsort((keys["b"], keys["a"], keys["null"]))
        ordered = keys[order]
        first = np.ones(len(ordered), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        code = np.empty(len(keys), np.int64)
        code[order] = np.cumsum(first) - 1
        size = int(first.sum())
        self.keys = ordered[first]
        self.n = np.zeros(size, np.int64)
        np.add.at(self.n, code, n)
        self.top = np.full(size, LOWEST)
        np.maximum.at(self.top, code, top)
        self.tie = np.full(size, HIGHEST)
        held = top == self.top[code]
        np.minimum.at(self.tie, code[held], tie[held])


def _longs(col: pa.ChunkedArray | pa.Array, fill: int) -> np.ndarray:
    return pc.fill_null(pc.cast(col, pa.int64()), fill).to_numpy(zero_copy_only=False)


def dense_extremes(df: DataFrame, group: str, key: str, value: str, tie: str, blocks: int | None = None, flush_keys: int = FLUSH_KEYS, hold_rows: int = HOLD_ROWS) -> DataFrame:
    """Per (``group``, ``key``): row count ``n``, greatest ``value`` and smallest ``tie`` among its rows.

    All four columns must be integers. Result columns: ``group long, key long, n long, top long,
    tie long``, one row per pair that occurs.

    * NULL in ``group`` or ``key`` is a group or key of its own; rows with NULL ``value`` count in
      ``n`` only; a pair without values has NULL ``top`` and ``tie``; NULL ``tie`` never wins.
    * Ties on the greatest value go to the smallest ``tie``; repeated rows count as often as given.
    * An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    blocks = blocks or 4 * shuffle_width(df.sparkSession)
    cols = [F.col(f"`{c}`").cast("long").alias(a) for c, a in ((group, "g"), (key, "k"), (value, "v"), (tie, "t"))]

    def encode(acc: _Accumulator) -> Iterator[pa.RecordBatch]:
        if not len(acc.keys):
            return
        mixed = (acc.keys["a"] * np.int64(0x9E3779B1) + acc.keys["b"]) * np.int64(0x2545F4914F6CDD1D)
        block = ((mixed >> np.int64(33)) & np.int64(0x7FFFFFFF)) % blocks
        order = np.argsort(block, kind="stable")
        bounds = np.flatnonzero(np.diff(block[order], prepend=-1))
        offsets = pa.array(np.append(bounds, len(order)), pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (acc.keys["a"], acc.keys["b"], acc.keys["null"].astype(np.int64), acc.n, acc.top, acc.tie)]
        yield pa.RecordBatch.from_arrays([pa.array(block[order][bounds].astype(np.int32)), *arrays], ["block", "a", "b", "null", "n", "top", "tie"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, waiting, held = _Accumulator(), [], 0
        for batch in batches:
            g, k, v, t = batch.columns
            keys = np.empty(len(batch), acc.keys.dtype)
            keys["a"], keys["b"] = _longs(g, 0), _longs(k, 0)
            keys["null"] = pc.is_null(g).to_numpy(zero_copy_only=False) + 2 * pc.is_null(k).to_numpy(zero_copy_only=False)
            none = pc.is_null(v).to_numpy(zero_copy_only=False)
            waiting.append((keys, np.ones(len(batch), np.int64), _longs(v, LOWEST), np.where(none, HIGHEST, _longs(t, HIGHEST))))
            held += len(batch)
            # as many new rows as there are keys, so that each row is sorted a bounded number of times
            if held > max(hold_rows, len(acc.keys)):
                acc.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, held = [], 0
                if len(acc.keys) >= flush_keys:
                    yield from encode(acc)
                    acc = _Accumulator()
        if waiting:
            acc.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        yield from encode(acc)

    def reduced(acc: _Accumulator) -> pa.RecordBatch:
        null = acc.keys["null"]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(acc.keys["a"], mask=(null & 1) > 0), pa.array(acc.keys["b"], mask=(null & 2) > 0), pa.array(acc.n),
                pa.array(acc.top, mask=acc.top == LOWEST), pa.array(acc.tie, mask=acc.tie == HIGHEST),
            ],
            ["group", "key", "n", "top", "tie"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, at, waiting, held = _Accumulator(), None, [], 0

        def take() -> None:
            if waiting:
                acc.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting.clear()

        for batch in batches:
            for row in range(len(batch)):
                if (block := batch.column(0)[row].as_py()) != at:
                    if at is not None:
                        take()
                        yield reduced(acc)
                    acc, at, held = _Accumulator(), block, 0
                a, b, null, n, top, tie = (batch.column(i)[row].values.to_numpy() for i in range(1, 7))
                keys = np.empty(len(a), acc.keys.dtype)
                keys["a"], keys["b"], keys["null"] = a, b, null
                waiting.append((keys, n, top, tie))
                held += len(a)
                if held > max(hold_rows, len(acc.keys)):
                    take()
                    held = 0
        if at is not None:
            take()
            yield reduced(acc)

    longs = T.ArrayType(T.LongType())
    parts = df.select(*cols).mapInArrow(split, T.StructType([T.StructField("block", T.IntegerType())] + [T.StructField(c, longs) for c in ("a", "b", "null", "n", "top", "tie")]))
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "group long, key long, n long, top long, tie long")


def heavy_sources(ipv4: DataFrame, frames: DataFrame, least_rows: int = 20, share: int = 50) -> DataFrame:
    """Per day the source addresses with at least ``least_rows`` rows and a ``1/share`` part of the
    day's rows, each with the frame of its longest packet.

    Columns ``day string, src_ip long, frame_number long``. Rows with NULL address count for the
    day's total only; an address whose lengths are all NULL has a NULL frame.
    """
    rows = once(ipv4, "frame_number", frame=F.col("frame_number"), src=F.col("src_ip"), size=F.col("total_length"))
    per = dense_extremes(with_day(rows, frames), "day", "src", "size", "frame")
    # read twice: for the totals, as a window would gather all addresses of a day in one task
    per = cut(per)
    totals = small_side(cut(per.groupBy(F.col("group").alias("__day")).agg(F.sum("n").alias("__all"))))
    return (
        per.where(F.col("key").isNotNull() & (F.col("n") >= least_rows))
        .join(totals, F.col("group") == F.col("__day"))
        .where(F.col("n") * share >= F.col("__all"))
        .select(day_text(F.col("group")).alias("day"), F.col("key").alias("src_ip"), F.col("tie").alias("frame_number"))
    )
