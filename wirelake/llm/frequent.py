"""Most frequent items in bounded memory: a count-min sketch per hash partition of the values.

Rows shrink to counts per Arrow batch before the shuffle, so a value that holds a third of all rows
travels as one row per batch. The values are then partitioned by their hash: every partition owns
its values, keeps one count-min sketch with conservative update and, per group, a bounded heap of
the values with the greatest estimates. The heaps of the partitions are disjoint, so merging them is
taking the greatest of their union.

A count is never underestimated; it is overestimated by more than ``e * rows of the partition /
width`` with probability below ``exp(-depth)``, and conservative update makes that rarer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.setsketch import identifier_rows
from wirelake.operators.capture import day_text, week_of
from wirelake.session import cut, kept, small_side

WIDTH, DEPTH, HEAP = 1 << 16, 4, 1024
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def cells(h: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Column of each hash in each row of the sketch: an array of ``depth`` rows."""
    x = h.view(np.uint64)[None, :] ^ _SEEDS[:depth, None]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(width)).astype(np.int64)


def conservative_add(sketch: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Add ``n`` of each of the distinct hashes; the new estimates.

    Only cells below the new estimate rise, to that estimate. Values of one call are raised
    together: a cell shared by two of them takes the greater, so no value is underestimated.
    """
    depth, width = sketch.shape
    at = cells(h, width, depth)
    rows = np.arange(depth)[:, None]
    now = sketch[rows, at].min(axis=0) + n
    np.maximum.at(sketch, (np.broadcast_to(rows, at.shape), at), np.broadcast_to(now, at.shape))
    return now


def frequent_items(df: DataFrame, group: list[str], item: str, top: int = HEAP, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The at most ``top`` items of greatest estimated count of each group and hash partition:
    ``group..., item string, estimate long``.

    Every item whose count exceeds that of all but ``top - 1`` items of its partition by more than
    the overestimation is among them; the heaps of one group are disjoint over the partitions.

    * NULL items do not count; NULL group values form groups; ties at the heap's end are broken by
      the item; repeated rows count as often as given; an empty table gives an empty result;
      other columns, whatever their names, are ignored.
    """
    names = [f"__g{i}" for i in range(len(group))]
    keys = [F.col(f"`{g}`").cast("string").alias(a) for g, a in zip(group, names, strict=True)]
    rows = df.where(F.col(f"`{item}`").isNotNull()).select(*keys, F.col(f"`{item}`").cast("string").alias("item"))
    head = ", ".join(f"{a} string" for a in names) + ", item string, n long"

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held >= 200_000:
                yield from counted(waiting)
                waiting, held = [], 0
        if waiting:
            yield from counted(waiting)

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).group_by([*names, "item"]).aggregate([([], "count_all")])
        for b in t.rename_columns([*names, "item", "n"]).select([*names, "item", "n"]).combine_chunks().to_batches():
            yield b

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((depth, width), np.int64)
        heap: dict[tuple, dict[str, int]] = {}
        least: dict[tuple, int] = {}
        for batch in batches:
            h, n = batch.column("h").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            _, first, code = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(code, weights=n).astype(np.int64)
            now = conservative_add(sketch, h[first], total)
            gid = pc.dictionary_encode(batch.column("g"))
            groups = gid.dictionary.to_pylist()
            floor = np.array([least.get(g, 0) for g in groups], np.int64)[gid.indices.to_numpy(zero_copy_only=False)[first]]
            keep = np.flatnonzero(now > floor)
            picked = batch.take(pa.array(first[keep]))
            for g, it, est in zip(picked.column("g").to_pylist(), picked.column("item").to_pylist(), now[keep].tolist(), strict=True):
                mine = heap.setdefault(g, {})
                mine[it] = est
                if len(mine) >= 2 * top:
                    heap[g] = dict(sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:top])
                    least[g] = min(heap[g].values()) if len(heap[g]) >= top else 0
        for g, mine in heap.items():
            best = sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:top]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(best), pa.string()), pa.array([x for x, _ in best], pa.string()), pa.array([x for _, x in best], pa.int64())], ["g", "item", "estimate"])

    # one JSON text stands for the group, so that NULLs are values
    gtext = F.to_json(F.array(*names)) if names else F.lit("")
    shrunk = rows.mapInArrow(shrink, head).select(gtext.alias("g"), "item", "n", F.xxhash64(F.concat_ws("\x01", gtext, F.col("item"))).alias("h"))
    found = shrunk.repartition("h").mapInArrow(heaps, "g string, item string, estimate long")
    parsed = F.from_json("g", "array<string>")
    types = {f.name: f.dataType for f in df.schema.fields}
    return found.select(*[F.get(parsed, F.lit(i)).cast(types[g]).alias(g) for i, g in enumerate(group)], "item", "estimate")


def weekly_heavy_hitters(ipv4: DataFrame, dns: DataFrame, tls: DataFrame, frames: DataFrame, least: int = 10, share: int = 100) -> DataFrame:
    """Items with at least ``least`` rows and a ``1/share`` part of their identifier's rows of a
    week: ``ident string, week string, item string``.

    The heaps of the count-min sketches propose; no estimate is too low, so nothing is missed as long
    as fewer than ``HEAP`` items of a partition reach the share, and at most ``share`` can. What they
    propose, at most ``share`` items and the overestimated of a group, is then counted exactly.
    """
    rows = kept(identifier_rows(ipv4, dns, tls, frames).select("ident", week_of(F.col("day")).alias("week"), "item"))
    totals = rows.groupBy("ident", "week").agg(F.count("*").alias("all"))
    proposed = frequent_items(rows, ["ident", "week"], "item").join(small_side(cut(totals)), ["ident", "week"])
    proposed = cut(proposed.where((F.col("estimate") >= least) & (F.col("estimate") * share >= F.col("all"))).select("ident", "week", "item", "all"))
    # counted before they are joined where the proposals are too many to broadcast: the hottest items
    # are among them and must not meet in one task
    keys = ["ident", "week", "item"]
    wanted = small_side(proposed)
    few = wanted is not proposed
    counts = (rows.join(wanted.drop("all"), keys, "left_semi") if few else rows).groupBy(*keys).agg(F.count("*").alias("n"))
    sure = counts.join(wanted, keys).where((F.col("n") >= least) & (F.col("n") * share >= F.col("all")))
    return sure.select("ident", day_text(F.col("week")).alias("week"), "item")


def top_items(ipv4: DataFrame, dns: DataFrame, tls: DataFrame, frames: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` items of greatest estimated count of each identifier and week, with the estimate."""
    rows = identifier_rows(ipv4, dns, tls, frames).select("ident", week_of(F.col("day")).alias("week"), "item")
    by = Window.partitionBy("ident", "week").orderBy(F.desc("estimate"), "item")
    # at most HEAP rows a partition and group are left here
    return frequent_items(rows, ["ident", "week"], "item").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("ident", day_text(F.col("week")).alias("week"), "item", "estimate", "rank")
