"""Distinct counts with mergeable set registers of a tunable logarithmic base.

A sketch has ``m`` registers. Every element starts one Poisson process of rate ``a`` in each
register; a register keeps ``floor(1 - log_b(x))`` of the smallest arrival time ``x`` it has seen,
so sketches of a union are the register-wise maximum. The superposition of an element's processes
is one process of rate ``m * a`` whose arrivals fall on uniformly random registers, so an element is
inserted by walking its arrivals in order and stopping at the first that cannot beat the smallest
register: for large sets most elements stop at once. All elements of a batch walk together as numpy
arrays.

A set of at most ``Sketch.few`` elements is kept as their sorted hashes, which takes no more room than
registers do and is exact; it becomes registers when it grows beyond that. Both forms merge with each
other, in any order, to the same result.

Relative standard error of a count: ``sqrt(((b + 1) / (b - 1) * ln(b) - 1) / m)``, see
:func:`count_error`; the joint estimate of two sketches carries its own error from the Fisher
information, see :func:`joint`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wirelake.operators.capture import day_text, once, plain_name, week_of, with_day
from wirelake.session import cut, kept, small_side


@dataclass(frozen=True)
class Sketch:
    """Parameters of a sketch: registers, base, rate, and the greatest register value less one."""

    m: int = 2048
    b: float = 1.001
    a: float = 20.0
    q: int = 65534

    @property
    def few(self) -> int:
        """Elements up to which a set is kept as hashes of 8 bytes; a register has 2."""
        return self.m // 4


def count_error(s: Sketch) -> float:
    """Relative standard error of a distinct count, whatever its size."""
    return float(np.sqrt(((s.b + 1) / (s.b - 1) * np.log(s.b) - 1) / s.m))


def _mixed(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: independent-looking bits of a hash for every salt."""
    x = h + salt * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def insert(registers: np.ndarray, hashes: np.ndarray, s: Sketch) -> None:
    """Add the elements with the given 64-bit hashes to one sketch, in place."""
    h = np.unique(hashes.view(np.uint64))
    x, step, log_b = np.zeros(len(h)), 0, np.log(s.b)
    low = int(registers.min())
    while len(h):
        # few elements walk many arrivals at a time, many elements one
        width = max(1, s.m // len(h))
        salts = np.uint64(2) * (np.arange(step, step + width, dtype=np.uint64))[None, :]
        bits = _mixed(h[:, None], salts + np.uint64(1))
        gaps = -np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / (s.m * s.a)
        arrivals = x[:, None] + np.cumsum(gaps, axis=1)
        with np.errstate(divide="ignore"):
            value = np.clip(np.floor(1 - np.log(arrivals) / log_b), 0, s.q + 1).astype(registers.dtype)
        good = value > low
        at = (_mixed(h[:, None], salts + np.uint64(2)) % np.uint64(s.m)).astype(np.int64)
        np.maximum.at(registers, at[good], value[good])
        low = int(registers.min())
        going = value[:, -1] > low
        h, x, step = h[going], arrivals[going, -1], step + width


def estimate(registers: np.ndarray, s: Sketch) -> float:
    """Distinct elements of a sketch; 0 for an empty one.

    One element leaves a register empty with probability exp(-a), so with ``a`` of 20 and two-byte
    registers neither end of their range needs a correction.
    """
    if not registers.any():
        return 0.0
    return float(s.m * (1 - 1 / s.b) / (s.a * np.log(s.b) * np.sum(s.b ** -registers.astype(np.float64))))


def joint(left: np.ndarray, right: np.ndarray, s: Sketch) -> dict[str, float]:
    """Union, intersection and Jaccard similarity of two sets by maximum likelihood.

    The numbers of registers where the left is greater, the right is greater, and both are equal
    have a trinomial distribution that depends only on the share of each set in the sum of sizes and
    on the Jaccard similarity; the similarity of greatest likelihood is found by golden section.
    ``error`` is the standard error of ``jaccard`` from the Fisher information.
    """
    na, nb = estimate(left, s), estimate(right, s)
    if na == 0 or nb == 0:
        return {"left": na, "right": nb, "union": na + nb, "intersection": 0.0, "jaccard": 0.0, "error": 0.0}
    u, v = na / (na + nb), nb / (na + nb)
    more, less = float((left > right).sum()), float((left < right).sum())
    same = s.m - more - less

    def p(x: float) -> float:
        return -float(np.log1p(-max(x, 0.0) * (s.b - 1) / s.b) / np.log(s.b))

    def split(j: float) -> tuple[float, float, float]:
        pm, pl = p(u - v * j), p(v - u * j)
        return max(pm, 1e-15), max(pl, 1e-15), max(1 - pm - pl, 1e-15)

    def loss(j: float) -> float:
        pm, pl, ps = split(j)
        return -(more * np.log(pm) + less * np.log(pl) + same * np.log(ps))

    low, high, g = 0.0, min(u / v, v / u), (5**0.5 - 1) / 2
    c, d = high - g * (high - low), low + g * (high - low)
    for _ in range(60):
        if loss(c) < loss(d):
            high, d = d, c
            c = high - g * (high - low)
        else:
            low, c = c, d
            d = low + g * (high - low)
    j, eps = (low + high) / 2, 1e-5
    up, down = split(min(j + eps, 1.0)), split(max(j - eps, 0.0))
    fisher = s.m * sum(((x - y) / (2 * eps)) ** 2 / z for x, y, z in zip(up, down, split(j), strict=True))
    union = (na + nb) / (1 + j)
    return {"left": na, "right": nb, "union": union, "intersection": j * union, "jaccard": j, "error": float(fisher**-0.5) if fisher > 0 else 0.0}


class Set:
    """A set that grows: sorted hashes while there are few, registers from then on."""

    __slots__ = ("s", "hashes", "registers")

    def __init__(self, s: Sketch, blob: bytes | None = None) -> None:
        self.s, self.hashes, self.registers = s, np.empty(0, np.uint64), None
        if blob is not None and blob[:1] == b"h":
            self.hashes = np.frombuffer(blob, "<u8", offset=1)
        elif blob is not None:
            self.registers = np.frombuffer(zlib.decompress(memoryview(blob)[1:]), "<u2").astype(np.uint16)

    def pack(self) -> bytes:
        """The set as bytes that :class:`Set` reads."""
        return b"h" + self.hashes.astype("<u8").tobytes() if self.registers is None else b"r" + zlib.compress(self.registers.astype("<u2").tobytes(), 1)

    @property
    def size(self) -> int:
        """Bytes held, about."""
        return 200 + (self.hashes.nbytes if self.registers is None else self.registers.nbytes)

    def add(self, hashes: np.ndarray) -> None:
        """Add elements by their 64-bit hashes."""
        if self.registers is None:
            self.hashes = np.unique(np.concatenate([self.hashes, hashes.view(np.uint64)]))
            if len(self.hashes) <= self.s.few:
                return
            hashes, self.hashes, self.registers = self.hashes, self.hashes[:0], np.zeros(self.s.m, np.uint16)
        insert(self.registers, hashes, self.s)

    def merge(self, other: Set) -> None:
        """The union with another set."""
        if other.registers is None:
            self.add(other.hashes)
        elif self.registers is None:
            hashes, self.hashes, self.registers = self.hashes, self.hashes[:0], other.registers.copy()
            insert(self.registers, hashes, self.s)
        else:
            np.maximum(self.registers, other.registers, out=self.registers)

    def dense(self) -> np.ndarray:
        """The registers, whatever the form."""
        if self.registers is not None:
            return self.registers
        registers = np.zeros(self.s.m, np.uint16)
        insert(registers, self.hashes, self.s)
        return registers

    def estimate(self) -> tuple[float, float]:
        """Distinct elements and the standard error of that, 0 where they are counted."""
        if self.registers is None:
            return float(len(self.hashes)), 0.0
        n = estimate(self.registers, self.s)
        return n, n * count_error(self.s)


def compared(left: Set, right: Set) -> dict[str, float]:
    """Union, intersection, Jaccard similarity and its standard error: counted where both sets are held
    as hashes, by :func:`joint` otherwise."""
    if left.registers is None and right.registers is None:
        both = len(np.intersect1d(left.hashes, right.hashes, assume_unique=True))
        union = len(left.hashes) + len(right.hashes) - both
        return {"union": float(union), "intersection": float(both), "jaccard": both / union if union else 0.0, "error": 0.0}
    return joint(left.dense(), right.dense(), left.s)


#: Bytes of sets that a split holds before it sends the ones it has not touched for longest.
HOLD_BYTES = 64 << 20
#: Rows that a split folds at once.
FOLD_ROWS = 100_000


def sketches(df: DataFrame, group: list[str], item: Column, s: Sketch = Sketch(), hold_bytes: int = HOLD_BYTES) -> DataFrame:
    """One sketch per group: ``group..., sketch binary``, the sets of :func:`partial_sketches` merged.

    * NULL items do not count; NULL group values form groups; repeated items count once; groups
      without items, and empty tables, give no row. Other columns are ignored.
    """
    return merged(partial_sketches(df, group, item, s, hold_bytes), group, s)


def partial_sketches(df: DataFrame, group: list[str], item: Column, s: Sketch = Sketch(), hold_bytes: int = HOLD_BYTES) -> DataFrame:
    """Sketches of the groups of each split: ``group..., sketch binary``, one or more rows a group.

    Each split folds its rows into one set per group and sends it once, so a hot group or item costs
    a split no more than any other; a set that comes back after it was sent for want of room costs no
    more bytes than its elements.
    """
    names = [f"__g{i}" for i in range(len(group))]
    types = {f.name: f.dataType for f in df.schema.fields}
    head = ", ".join(f"{a} {types[g].simpleString()}" for a, g in zip(names, group, strict=True))
    rows = df.where(item.isNotNull()).select(*[F.col(f"`{g}`").alias(a) for g, a in zip(group, names, strict=True)], F.xxhash64(item).alias("__h"))
    schema = [to_arrow_type(types[g]) for g in group]

    def send(done: list[tuple[tuple, Set]]) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k, _ in done], type=schema[i]) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([x.pack() for _, x in done], pa.binary())], [*names, "sketch"])

    def slices(t: pa.Table) -> Iterator[tuple[tuple, np.ndarray]]:
        code = np.zeros(len(t), np.int64)
        dictionaries = []
        for i in range(len(names)):
            enc = pc.dictionary_encode(t.column(i).combine_chunks(), null_encoding="encode")
            enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
            dictionaries.append(enc.dictionary)
            code = code * len(enc.dictionary) + enc.indices.to_numpy(zero_copy_only=False)
        h = t.column(len(names)).to_numpy()
        order = np.argsort(code, kind="stable")
        bounds = np.flatnonzero(np.diff(code[order], prepend=-1))
        for a, z in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
            c, key = int(code[order[a]]), []
            for d in reversed(dictionaries):
                key.append(d[c % len(d)].as_py())
                c //= len(d)
            yield tuple(reversed(key)), h[order[a:z]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Set] = {}
        waiting, n, size = [], 0, 0
        for batch in _with_end(batches):
            if batch is not None:
                waiting.append(batch)
                n += len(batch)
            if not waiting or (batch is not None and n < FOLD_ROWS):
                continue
            for key, hashes in slices(pa.Table.from_batches(waiting)):
                # put last, so that the first ones are those not touched for longest
                if (mine := held.pop(key, None)) is None:
                    mine = Set(s)
                else:
                    size -= mine.size
                mine.add(hashes)
                size += mine.size
                held[key] = mine
            waiting, n = [], 0
            out = []
            while size > hold_bytes and len(held) > 1:
                key = next(iter(held))
                out.append((key, held.pop(key)))
                size -= out[-1][1].size
                if len(out) == 256:
                    yield send(out)
                    out = []
            if out:
                yield send(out)
        left = list(held.items())
        for at in range(0, len(left), 256):
            yield send(left[at : at + 256])

    return rows.mapInArrow(fold, f"{head}, sketch binary").select(*[F.col(a).alias(g) for a, g in zip(names, group, strict=True)], "sketch")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def merged(parts: DataFrame, names: list[str], s: Sketch) -> DataFrame:
    """Union of the sketches of each group: ``names..., sketch``. Also rolls days up into weeks. The sets
    of a group meet in a stream that holds one of them at a time."""
    schema = parts.select(*names, "sketch").schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)) if names else [()] * len(batch)
            done = []
            for key, blob in zip(keys, batch.column(len(names)), strict=True):
                if key != at or held is None:
                    if held is not None:
                        done.append((at, held))
                    at, held = key, Set(s)
                held.merge(Set(s, blob.as_py()))
            if done:
                yield rows(done, batch.schema)
        if held is not None:
            yield rows([(at, held)], batch.schema)

    def rows(done: list[tuple[tuple, Set]], kind: pa.Schema) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k, _ in done], type=kind.field(i).type) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([x.pack() for _, x in done], kind.field(len(names)).type)], kind.names)

    return parts.select(*names, "sketch").repartition(*names).sortWithinPartitions(*names).mapInArrow(merge, schema)


def with_estimate(df: DataFrame, s: Sketch = Sketch()) -> DataFrame:
    """Adds ``estimate double``, the distinct count of the column ``sketch``, and ``error double``, one
    standard error of it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [Set(s, b.as_py()).estimate() for b in batch.column(batch.schema.get_field_index("sketch"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([v[i] for v in values], pa.float64()) for i in (0, 1)]], [*batch.schema.names, "estimate", "error"])

    return df.mapInArrow(add, df.withColumns({"estimate": F.lit(0.0), "error": F.lit(0.0)}).schema)


def identifier_rows(ipv4: DataFrame, dns: DataFrame, tls: DataFrame, frames: DataFrame) -> DataFrame:
    """Countable identifiers of every frame with a day: ``ident, grp, item`` strings and ``day``."""
    parts = (
        ("src_ip", ipv4, F.col("protocol").cast("string"), F.col("src_ip").cast("string")),
        ("query_name", dns, F.col("query_type").cast("string"), plain_name(F.col("query_name"))),
        ("sni", tls, F.col("version").cast("string"), plain_name(F.col("sni"))),
    )
    out = None
    for ident, df, grp, item in parts:
        # joined one by one, each is already partitioned by frame
        rows = with_day(once(df, "frame_number", ident=F.lit(ident), grp=grp, item=item).where(F.col("item").isNotNull()), frames)
        out = rows if out is None else out.unionByName(rows)
    return out


def in_groups(rows: DataFrame) -> DataFrame:
    """Every row in its group and in the group ``*``; a NULL group only in the latter."""
    both = F.array_compact(F.array(F.col("grp"), F.lit("*")))
    return rows.select("ident", "day", "item", F.explode(both).alias("grp"))


def standout_days(ipv4: DataFrame, dns: DataFrame, tls: DataFrame, frames: DataFrame, s: Sketch = Sketch(), least: int = 20, factor: float = 2.0, sigmas: float = 5.0) -> DataFrame:
    """Days whose distinct count is at least ``least`` and ``factor`` times the median of its week.

    Counts are estimated from sketches, and the estimates decide wherever they differ from a bound by
    more than ``sigmas`` standard errors. Only the (identifier, group, week) sets of days that lie
    nearer to a bound are counted exactly. Columns ``ident string, grp string, day string``.
    """
    rows = kept(identifier_rows(ipv4, dns, tls, frames).select("ident", "grp", "day", "item"))
    grouped = in_groups(rows).select("ident", "grp", "day", "item", week_of(F.col("day")).alias("week"))
    counts = cut(with_estimate(sketches(grouped, ["ident", "grp", "week", "day"], F.col("item"), s), s).drop("sketch"))
    rated = against_week(counts, least, factor, sigmas)
    open_ = cut(rated.where("open").select("ident", "grp", "week").distinct())
    few = small_side(open_)
    sure = rated.join(few, ["ident", "grp", "week"], "left_anti").where("standing_out").select("ident", "grp", "day")
    # distinct before counting: both aggregate on the map side, so a hot group is spread over its items
    exact = grouped.join(few, ["ident", "grp", "week"], "left_semi").dropDuplicates()
    exact = exact.groupBy("ident", "grp", "week", "day").agg(F.count("*").cast("double").alias("estimate"), F.lit(0.0).alias("error"))
    found = sure.unionByName(against_week(exact, least, factor, sigmas).where("standing_out").select("ident", "grp", "day"))
    return found.select("ident", "grp", day_text(F.col("day")).alias("day"))


def against_week(counts: DataFrame, least: float, factor: float, sigmas: float) -> DataFrame:
    """Every day of ``counts`` with ``standing_out``, whether it is at or over both bounds, and ``open``,
    whether the errors leave that undecided; days of a week without a row count 0."""
    week = counts.groupBy("ident", "grp", "week").agg(F.sort_array(F.collect_list(F.struct("estimate", "error", "day"))).alias("days"))
    # seven days, so the median is the fourth smallest; absent days are zeros in front
    few = F.size("days") < 4
    median = F.when(~few, F.expr("days[size(days) - 4]"))
    days = week.select("ident", "grp", "week", median.alias("__m"), F.inline("days"))
    bound = F.coalesce(F.col("__m.estimate"), F.lit(0.0)) * factor
    # the error of the difference of two independent estimates
    by_week = sigmas * F.sqrt(F.col("error") ** 2 + (F.coalesce(F.col("__m.error"), F.lit(0.0)) * factor) ** 2)
    over = F.col("estimate") - bound
    enough = F.col("estimate") - least
    clear_no = (over < -by_week) | (enough < -sigmas * F.col("error"))
    clear_yes = (over >= by_week) & (enough >= sigmas * F.col("error"))
    return days.select("ident", "grp", "week", "day", ((over >= 0) & (enough >= 0)).alias("standing_out"), (~clear_no & ~clear_yes).alias("open"))


def daily_counts(ipv4: DataFrame, dns: DataFrame, tls: DataFrame, frames: DataFrame, s: Sketch = Sketch()) -> DataFrame:
    """Sketched distinct counts of every identifier, group and day, and of every week by merging its
    days: ``ident, grp, win, estimate, error``, the error being one standard error."""
    rows = in_groups(identifier_rows(ipv4, dns, tls, frames)).withColumn("week", week_of(F.col("day")))
    days = cut(sketches(rows, ["ident", "grp", "week", "day"], F.col("item"), s))
    weeks = merged(days.drop("day"), ["ident", "grp", "week"], s)
    both = days.select("ident", "grp", F.concat(F.lit("day "), day_text(F.col("day"))).alias("win"), "sketch").unionByName(
        weeks.select("ident", "grp", F.concat(F.lit("week "), day_text(F.col("week"))).alias("win"), "sketch")
    )
    return with_estimate(both, s).select("ident", "grp", "win", "estimate", "error")


def day_overlaps(ipv4: DataFrame, dns: DataFrame, tls: DataFrame, frames: DataFrame, s: Sketch = Sketch()) -> DataFrame:
    """Union, intersection and Jaccard similarity of each identifier's and group's items on a day
    and on the next one that has any: ``ident, grp, day, next_day, n_union, n_both, jaccard,
    error``, the error being one standard error of ``jaccard``."""
    rows = in_groups(identifier_rows(ipv4, dns, tls, frames))
    days = cut(sketches(rows, ["ident", "grp", "day"], F.col("item"), s))
    # one row a day: the window holds no more than the days of a group
    by = Window.partitionBy("ident", "grp").orderBy("day")
    later = days.select("ident", "grp", "day", F.lead("day").over(by).alias("next_day")).where("next_day IS NOT NULL")
    after = days.select("ident", "grp", F.col("day").alias("next_day"), F.col("sketch").alias("after"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [compared(Set(s, x.as_py()), Set(s, y.as_py())) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array([f[k] for f in found], pa.float64()) for k in ("union", "intersection", "jaccard", "error")]], [*batch.schema.names[:4], "n_union", "n_both", "jaccard", "error"])

    pairs = days.join(later, ["ident", "grp", "day"]).join(after, ["ident", "grp", "next_day"]).select("ident", "grp", "day", "next_day", "sketch", "after")
    return pairs.mapInArrow(compare, "ident string, grp string, day int, next_day int, n_union double, n_both double, jaccard double, error double").select(
        "ident", "grp", day_text(F.col("day")).alias("day"), day_text(F.col("next_day")).alias("next_day"), "n_union", "n_both", "jaccard", "error"
    )


def counts_within_error(ipv4: DataFrame, dns: DataFrame, tls: DataFrame, frames: DataFrame, sigmas: float = 6.0) -> DataFrame:
    """Exact distinct counts beside :func:`daily_counts`: ``ident, grp, win, n, within``, the last
    telling whether the estimate is at most ``sigmas`` of its errors away."""
    rows = in_groups(identifier_rows(ipv4, dns, tls, frames))
    windows = F.array(F.concat(F.lit("day "), day_text(F.col("day"))), F.concat(F.lit("week "), day_text(week_of(F.col("day")))))
    exact = rows.select("ident", "grp", F.explode(windows).alias("win"), "item").dropDuplicates().groupBy("ident", "grp", "win").agg(F.count("*").alias("n"))
    both = exact.join(daily_counts(ipv4, dns, tls, frames), ["ident", "grp", "win"], "full")
    return both.select("ident", "grp", "win", "n", F.coalesce(F.abs(F.col("estimate") - F.col("n")) <= sigmas * F.col("error") + 0.01, F.lit(False)).alias("within"))


def overlaps_within_error(ipv4: DataFrame, dns: DataFrame, tls: DataFrame, frames: DataFrame, sigmas: float = 6.0) -> DataFrame:
    """Exact unions and intersections beside :func:`day_overlaps`: ``ident, grp, day, next_day, n_union,
    n_both, within``."""
    rows = in_groups(identifier_rows(ipv4, dns, tls, frames)).dropDuplicates()
    found = day_overlaps(ipv4, dns, tls, frames).select("ident", "grp", "day", "next_day", F.col("jaccard").alias("__j"), "error")
    rows = rows.withColumn("day", day_text(F.col("day")))
    # each item once for a pair of days, with how many of the two it is in
    left = rows.join(found.select("ident", "grp", "day", "next_day"), ["ident", "grp", "day"])
    right = rows.withColumnRenamed("day", "next_day").join(found.select("ident", "grp", "day", "next_day"), ["ident", "grp", "next_day"])
    items = left.unionByName(right).groupBy("ident", "grp", "day", "next_day", "item").agg(F.count("*").alias("in"))
    exact = items.groupBy("ident", "grp", "day", "next_day").agg(F.count("*").alias("n_union"), F.count(F.when(F.col("in") == 2, 1)).alias("n_both"))
    both = exact.join(found, ["ident", "grp", "day", "next_day"])
    return both.select("ident", "grp", "day", "next_day", "n_union", "n_both", (F.abs(F.col("__j") - F.col("n_both") / F.col("n_union")) <= sigmas * F.col("error") + 1e-6).alias("within"))
