"""Documents packed into containers of fixed capacity by swap-based local search.

Sizes are tokens of a public tokenizer. Items are spread by hash over groups of about ``GROUP``
items, so a group fits a task whatever the corpus size and no group sees skew. A group is first
packed greedily, largest first, each item into the fullest bin that takes it. Then a local search
works on the bins that are not full: it moves an item, or swaps one for one or two for one between
two bins, whenever that raises the sum of squared fills, which makes full bins fuller and empties
others; a bin that became empty is gone. The search ends when no exchange is left.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.session import cut, spread

CAPACITY = 2048
#: Items of a group: bounds the memory and time of one local search.
GROUP = 4000
#: Place of the tokenizer's rank file.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank file (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(ranks: str):
    """The tiktoken encoding of a rank file."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``doc_id, n_tokens long`` of every row; NULL and empty texts have 0 tokens."""
    kind = documents.schema[doc_id].dataType.simpleString()
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return spread(docs).mapInArrow(count, f"doc_id {kind}, n_tokens long")


class _Bin:
    __slots__ = ("items", "fill")

    def __init__(self) -> None:
        self.items: list[tuple[int, int]] = []  # (size, index), ascending
        self.fill = 0

    def put(self, item: tuple[int, int]) -> None:
        insort(self.items, item)
        self.fill += item[0]

    def take(self, item: tuple[int, int]) -> None:
        self.items.pop(bisect_left(self.items, item))
        self.fill -= item[0]

    def of_size(self, size: int) -> tuple[int, int] | None:
        """An item of exactly or else the greatest size up to ``size``."""
        at = bisect_right(self.items, (size, 1 << 60)) - 1
        return self.items[at] if at >= 0 else None


def pack(sizes: np.ndarray, capacity: int = CAPACITY, search: bool = True) -> np.ndarray:
    """Bin number of each item; sizes are between 1 and the capacity. Bins are numbered from 0."""
    bins: list[_Bin] = []
    room: list[tuple[int, int]] = []  # (space left, bin), ascending: the first that fits is the fullest
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append(_Bin())
        bins[b].put((size, i))
        if left - size:
            insort(room, (left - size, b))
    # every exchange raises the sum of squared fills, so this ends
    while search and _improve(bins, capacity):
        pass
    out = np.empty(len(sizes), np.int64)
    for b, x in enumerate(y for y in bins if y.items):
        out[[i for _, i in x.items]] = b
    return out


def _improve(bins: list[_Bin], capacity: int) -> bool:
    """One round over the pairs of bins with room, fullest first; whether anything changed.

    For a fuller bin ``a`` and an emptier bin ``b`` every exchange that puts a net ``g > 0`` from
    ``b`` into ``a`` raises the sum of squares by ``2 g (a.fill - b.fill) + 2 g * g``.
    """
    opened = sorted((x for x in bins if x.items and x.fill < capacity), key=lambda x: -x.fill)
    changed = False
    for k, a in enumerate(opened):
        if not a.items:
            continue
        # emptiest donors first: they are the ones that can vanish
        for b in reversed(opened[k + 1 :]):
            if a.fill >= capacity:
                break
            if b.items and b.fill <= a.fill and _exchange(a, b, capacity - a.fill):
                changed = True
    return changed


def _exchange(a: _Bin, b: _Bin, room: int) -> bool:
    """The best exchange that fills at most ``room`` of ``a`` from ``b``; done in place."""
    best: tuple[int, tuple, tuple] | None = None
    # move: the largest item that fits
    if (x := b.of_size(room)) is not None:
        best = (x[0], (x,), ())
    if best is None or best[0] < room:
        last = 0
        for y in a.items:  # one for one, one of b for one of a
            if y[0] == last:
                continue
            last = y[0]
            x = b.of_size(room + y[0])
            if x is not None and x[0] > y[0] and (best is None or x[0] - y[0] > best[0]):
                best = (x[0] - y[0], (x,), (y,))
        if (best is None or best[0] < room) and len(a.items) > 1:  # one of b for two of a
            for i, y in enumerate(a.items[:-1]):
                for z in a.items[i + 1 :]:
                    if y[0] + z[0] >= b.items[-1][0]:
                        break
                    x = b.of_size(room + y[0] + z[0])
                    if x is not None and x[0] > y[0] + z[0] and (best is None or x[0] - y[0] - z[0] > best[0]):
                        best = (x[0] - y[0] - z[0], (x,), (y, z))
        if (best is None or best[0] < room) and len(b.items) > 1:  # two of b for one of a
            for y in a.items:
                target = room + y[0]
                i, j = 0, len(b.items) - 1
                while i < j:  # two pointers over the ascending sizes
                    total = b.items[i][0] + b.items[j][0]
                    if total > target:
                        j -= 1
                        continue
                    if total > y[0] and (best is None or total - y[0] > best[0]):
                        best = (total - y[0], (b.items[i], b.items[j]), (y,))
                    i += 1
    if best is None or best[0] <= 0:
        return False
    for x in best[1]:
        b.take(x)
    for y in best[2]:
        a.take(y)
    for x in best[1]:
        a.put(x)
    for y in best[2]:
        b.put(y)
    return True


def containers(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str = RANKS, group: int = GROUP) -> DataFrame:
    """An assignment of every non-empty text: ``doc_id, piece int, container string, n_tokens int,
    token_from long``.

    A text of at most ``capacity`` tokens is one piece, number 0, whole in one container. A longer
    one is cut at ``capacity`` tokens: its full pieces fill containers of their own and only its rest
    is packed with others.

    * NULL and empty texts, and texts without a token, have no row; NULL ids pass through as one more
      value; equal texts and repeated rows are packed as often as they stand there; an empty table
      gives an empty result; other columns, whatever their names, are ignored.
    """
    # read three times: to size the groups, to pack, and for the full pieces
    counts = cut(token_counts(documents, doc_id, text, ranks).where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()))
    rest = counts.where(F.col("n_tokens") % capacity != 0)
    n_groups = max(1, -(-rest.count() // group))
    full = counts.where(F.col("n_tokens") >= capacity).select("doc_id", "row", F.explode(F.sequence(F.lit(0), (F.expr(f"n_tokens div {capacity}") - 1).cast("int"))).alias("piece"))
    whole = full.select(
        "doc_id", "piece", F.concat(F.lit("f"), F.col("row").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("container"),
        F.lit(capacity).alias("n_tokens"), (F.col("piece").cast("long") * capacity).alias("token_from"),
    )
    left = rest.select("doc_id", "row", F.expr(f"int(n_tokens div {capacity})").alias("piece"), (F.col("n_tokens") % capacity).cast("int").alias("n_tokens"), F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int").alias("grp"))
    kind = counts.schema["doc_id"].dataType.simpleString()

    def assign(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        bins = pack(t["n_tokens"].to_numpy(), capacity)
        names = pa.array([f"g{t['grp'][0]}.{b}" for b in bins], pa.string())
        return t.select(["doc_id", "piece"]).append_column("container", names).append_column("n_tokens", t["n_tokens"])

    packed = left.groupBy("grp").applyInArrow(assign, f"doc_id {kind}, piece int, container string, n_tokens int")
    return packed.withColumn("token_from", F.col("piece").cast("long") * capacity).unionByName(whole)
