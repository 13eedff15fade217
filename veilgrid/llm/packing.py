"""Packing of token sequences: dominance reduction, then best fit.

Items of equal length are alike, so an instance is a histogram of lengths, which has no more entries than the
capacity however many items there are. The plan is found on the histogram, as runs of alike sequences; items
are then dealt to it by their rank among items of their length, which is computed where they lie.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bpe import default_tokenizer, encode_column
from .common import Scratch, blocks, hash62, rank_within

#: Items of one length that one bucket holds on the average while they are ranked.
BUCKET_ROWS = 2_000


class _Bag:
    """A multiset of lengths that finds the largest length up to a bound."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, sizes: Counter, times: int) -> None:
        for s, c in sizes.items():
            self.n[s] -= c * times
            if not self.n[s]:
                del self.n[s]
                self.sizes.pop(bisect_left(self.sizes, s))

    def without(self, used: Counter):
        """For a length: how many are left beside those used."""
        return lambda s: self.n[s] - used[s]

    def largest(self, most: int, used: Counter) -> int | None:
        left = self.without(used)
        for i in range(bisect_right(self.sizes, most) - 1, -1, -1):
            if left(self.sizes[i]) > 0:
                return self.sizes[i]
        return None

    def smallest(self, k: int, used: Counter, above: int = 0) -> list[int]:
        """The k smallest over a length, beside those used; fewer if there are no more."""
        left, out = self.without(used), []
        for i in range(bisect_right(self.sizes, above), len(self.sizes)):
            out += [self.sizes[i]] * min(k - len(out), left(self.sizes[i]))
            if len(out) == k:
                break
        return out


def _dominating(bag: _Bag, j: int, capacity: int) -> Counter | None:
    """A set with an item of length j that dominates every other feasible set with it, if one is proven.

    Set A dominates set B if B's items can be put into A's, each item of A taking items of no greater total. Then
    some best packing has A as a sequence. With R left beside j, and k the longest item that fits in R:
    nothing fits: {j}. k fills R, or no two others fit in R together: {j, k}, as any other set is one item
    of no more than k, or fits into an exactly filled R as a whole. No three others fit: {j, k, b}, b the longest
    beside k, if no two items over b fit together, as then any pair has a member up to b and another up to k.
    """
    used = Counter([j])
    rest = capacity - j
    k = bag.largest(rest, used)
    if k is None:
        return used
    if k == rest:
        return used + Counter([k])
    low = bag.smallest(3, used)
    if len(low) < 2 or low[0] + low[1] > rest:
        return used + Counter([k])
    if len(low) < 3 or sum(low) > rest:
        pair = used + Counter([k])
        if (b := bag.largest(rest - k, pair)) is not None:
            over = bag.smallest(2, used, above=b)
            if len(over) < 2 or sum(over) > rest:
                return pair + Counter([b])
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs items, given as counts by length, into sequences: (lengths, how many such sequences)."""
    bag, out = _Bag(counts), []
    if bag.sizes and (bag.sizes[0] < 1 or bag.sizes[-1] > capacity):
        raise ValueError("a length must lie between 1 and the capacity")
    changed = True
    while changed and bag.sizes:
        changed = False
        for j in bag.sizes[::-1]:
            while bag.n.get(j) and (found := _dominating(bag, j, capacity)):
                times = min(bag.n[s] // c for s, c in found.items())
                out.append((tuple(sorted(found.elements(), reverse=True)), times))
                bag.take(found, times)
                changed = True
    return out + _best_fit(bag, capacity)


def _best_fit(bag: _Bag, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of the rest, longest first; alike sequences are filled together."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)  # by what is left: runs of sequences
    left: list[int] = []
    for s in bag.sizes[::-1]:
        n = bag.n[s]
        while n:
            i = bisect_left(left, s)
            if i == len(left):
                fill = min(n, capacity // s)
                groups = [((), n // fill)] if n >= fill else []
                n -= fill * (groups[0][1] if groups else 0)
                made = [(((s, fill),), g) for _, g in groups]
                if not groups:
                    made, fill, n = [(((s, n),), 1)], n, 0
                r = capacity - s * fill
            else:
                at = left[i]
                have, many = open_[at].pop()
                fill = min(n, at // s)
                take = min(many, n // fill)
                if take < many:
                    open_[at].append((have, many - take))
                if not open_[at]:
                    del open_[at]
                    left.pop(i)
                n -= take * fill
                made, r = [(have + ((s, fill),), take)], at - s * fill
            if r not in open_:
                insort(left, r)
            open_[r] += made
    return [(tuple(s for s, k in have for _ in range(k)), many) for runs in open_.values() for have, many in runs]


def pack(items: DataFrame, length: str, order: list[str], capacity: int) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 in each sequence) to items of 1 to `capacity` tokens.

    `order` names columns that tell items of one length apart; rows equal in them may swap places. Nulls there are
    values like any other; a null length fails, as do lengths out of bounds. An empty table gives no rows.
    """
    spark = items.sparkSession
    hist = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # as many rows as there are lengths: at most `capacity`
    if None in hist:
        raise ValueError("an item has no length")
    runs, sequence, used = [], 0, Counter()
    for sizes, times in plan(hist, capacity):
        offset = 0
        for s in sizes:
            runs.append((s, used[s], sequence, offset))
            used[s] += times
            offset += s
        sequence += times
    runs.sort()
    told = np.array(runs, np.int64).reshape(-1, 4)
    keys = (told[:, 0] << 45) + told[:, 1]  # by length, then by rank in it
    sent = spark.sparkContext.broadcast((keys, told))
    nb = max(1, sum(hist.values()) // BUCKET_ROWS)
    names = items.columns
    keyed = items.withColumn("__k", F.expr("0L") + hash62(*order)).withColumn("__b", F.col("__k") % F.lit(nb))
    ranked = rank_within(keyed, [length], "__b", [F.col("__k"), *map(F.col, order)], "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, told = sent.value
        for b in batches:
            size, rank = (b.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in (length, "__rank"))
            at = np.searchsorted(keys, (size << 45) + rank - 1, "right") - 1
            run = told[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(run[:, 2] + rank - 1 - run[:, 1]), pa.array(run[:, 3])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "__rank").mapInArrow(place, schema)


def pieces(df: DataFrame, key_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of every text: its ids, then end_id; only what is longer than `capacity` is cut, from the front.

    Rows: key, piece, start, length, ids_crc32. A null or empty text is the end id alone. Null and repeated keys are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end_id], "<u4").tobytes()
        for batch in blocks(batches, "text", 8 << 20):
            ids, ends = encode_column(batch.column("text"), path)
            ids = ids.astype("<u4")
            n = np.diff(ends) + 1
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            final = piece == count[row] - 1
            crc = np.empty(len(row), np.int64)
            for i, (a, size, f) in enumerate(zip((ends[row] + start).tolist(), length.tolist(), final.tolist(), strict=True)):
                own = zlib.crc32(ids[a : a + size - f].tobytes())
                crc[i] = zlib.crc32(last, own) if f else own
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["key", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack_texts(df: DataFrame, key_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """pieces() of all texts, packed: with sequence_id and offset."""
    made = Scratch(df.sparkSession).save(pieces(df, key_col, text_col, path, capacity, end_id), "pieces")
    return pack(made, "length", ["key", "piece", "ids_crc32"], capacity)


def op1_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    out = pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", default_tokenizer(), 4096, 1)
    return out.withColumnRenamed("key", "doc_id")
