"""Best-fit decreasing packing of token pieces, with a segment tree over remaining capacities.

Bins are not kept one by one: a *run* stands for many bins with consecutive numbers and the same
remaining capacity, and items of one length are placed by whole runs. As best fit would go on
filling the tightest bin while the item fits, a run of bins takes ``capacity // length`` items each.
The plan therefore depends on the histogram of lengths (at most as long as the capacity), not on the
number of pieces; finding the tightest fitting run is a descent of the segment tree. Pieces then look
up their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.llm import tokens
from driftframe.llm.common import cut, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
#: Rows of the plan that are broadcast at most; a longer plan is joined by shuffling.
BROADCAST_ROWS = 200_000


class Tightest:
    """Segment tree over capacities 0..size: which capacities have open runs; finds the least one >= x."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.tree = bytearray(2 * self.n)

    def put(self, capacity: int, there: bool) -> None:
        i = capacity + self.n
        self.tree[i] = there
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def least(self, x: int) -> int | None:
        i = x + self.n
        if self.tree[i]:
            return x
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i + (not self.tree[2 * i])
                return i - self.n
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, items, first bin, items per bin, offset in the bin).

    The items of rank first..first+items-1 go to bins first_bin + (rank - first) // per_bin, one behind
    the other from ``offset``. Lengths outside 1..capacity raise.
    """
    tree, runs, out, bins = Tightest(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                per = capacity // length
                first, count, room = bins, -(-left // per), capacity
                bins += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.put(room, False)
                per = room // length
            full = min(count, left // per)
            taken = []
            if full:
                taken.append((first, full, per))
            if full < count and left - full * per:
                taken.append((first + full, 1, left - full * per))
            for at, n, each in taken:
                out.append((length, rank, n * each, at, each, capacity - room))
                rank, left = rank + n * each, left - n * each
                _open(runs, tree, room - each * length, at, n)
            used = sum(n for _, n, _ in taken)
            _open(runs, tree, room, first + used, count - used)
    return out


def _open(runs: dict[int, list[tuple[int, int]]], tree: Tightest, room: int, first: int, count: int) -> None:
    if room and count:
        runs.setdefault(room, []).append((first, count))
        tree.put(room, True)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece of each document (doc_id, text): its ids, then ``end_id``; only longer ones are cut.

    ``task`` and ``nth`` number the pieces of a length within the task that made them. Null text is
    empty (a piece of one id); repeated rows stay repeated.
    """
    small_batches(docs.sparkSession)
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def make(batches):
        encode, task, seen = tokens.encoder(tokenizer_path, "word").encode, TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = [[] for _ in range(7)]
            for doc, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    seen[n] = seen.get(n, -1) + 1
                    for column, value in zip(rows, (doc, k, at // 4, n, zlib.crc32(part), task, seen[n])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _ARROW)], _NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, PIECES)


_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_ARROW = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in PIECES.split(", ")]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text).

    An empty table gives no rows; other columns of ``docs`` are ignored. Memory of the driver: the
    histogram (``capacity`` rows) and the plan made from it.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = cut(made.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, capacity)
    places = spark.createDataFrame(rows, "length long, first_rank long, items long, first_bin long, per_bin long, base long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "length", "before")
    ranked = made.join(bases.hint("merge"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    if len(rows) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    at = F.col("rank") - F.col("first_rank")
    placed = ranked.join(places, (ranked["length"] == places["length"]) & (at >= 0) & (at < F.col("items")))
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first_bin") + F.floor(at / F.col("per_bin")).cast("long")).alias("sequence_id"),
        (F.col("base") + at % F.col("per_bin") * ranked["length"]).alias("offset"),
    )
