"""Best-fit decreasing packing of documents into sequences of a fixed capacity.

Best-fit decreasing takes pieces from long to short and puts each into the open bin with the least
room that still holds it. A segment tree over remaining capacities finds that room in logarithmic
time. Bins with equal room are interchangeable and so are pieces of equal length, so the tree is
walked once for a run of equal pieces and the whole corpus is packed from its histogram of lengths:
at most `capacity` numbers reach the driver whatever the corpus holds, and the packing is the one
that a single best-fit queue over all documents would give. Pieces then learn their place from their
rank among pieces of equal length. No group of documents meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_batches
from .tokenizing import AT_ONCE, worker_tokenizer

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class RoomTree:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open bins with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of an open bin that holds `length`."""
        node = self.size + length
        if self.count[node]:
            return length
        while node > 1:  # up to the first right sibling that has bins, then down to its leftmost leaf
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first_rank, first_bin, per_bin, offset) that place every piece of a histogram.

    The piece of rank r in a run, i = r - first_rank, goes to bin first_bin + i // per_bin at
    offset + (i % per_bin) * length.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a length is outside 1..capacity")
    tree, open_bins, runs, bins = RoomTree(capacity), defaultdict(list), [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            per_bin = room // length
            full = min(n, left // per_bin)
            rest = left - full * per_bin if full < n else 0  # of a bin that is not filled up
            runs.append((length, rank, first, per_bin, capacity - room))
            rank, left = rank + full * per_bin + rest, left - full * per_bin - rest
            leave(room - per_bin * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            untouched = full + (rest > 0)
            leave(room, first + untouched, n - untouched)
    return runs


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of each document (its ids, then end_id), with the length's running number in the task.

    keep_ids adds the ids themselves (binary, little-endian unsigned 32-bit).
    """

    def make():
        own, part, seen, end = worker_tokenizer(tokenizer), TaskContext.get().partitionId(), defaultdict(int), np.array([end_id], "<u4").tobytes()

        def step(batch: pa.RecordBatch):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.ids(batch.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    data = ids[at : at + 4 * capacity]
                    n = len(data) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(data), part, seen[n], *([data] if keep_ids else [])))
                    seen[n] += 1
            return list(zip(*rows))

        return step

    return map_batches(docs.select("doc_id", "text"), make, PIECES + ", ids binary" * keep_ids, gather=AT_ONCE, caches=True)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Packs all documents; one row for each piece with sequence_id and offset.

    Only documents longer than `capacity` are cut. Null texts count as empty (one end id). Rows with
    equal or null doc_id are packed one by one. Extra columns are ignored; no documents, no rows.
    """
    spark = docs.sparkSession
    pieces = checkpoint(cut(docs, capacity, end_id, tokenizer, keep_ids))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = sorted(plan(histogram, capacity))
    keys = [(r[0], r[1]) for r in runs]
    known = spark.sparkContext.broadcast((keys, runs))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * keep_ids

    def make():
        keys, runs = known.value

        def step(batch: pa.RecordBatch):
            bins, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                _, first_rank, first_bin, per_bin, offset = runs[bisect_right(keys, (length, rank)) - 1]
                k, j = divmod(rank - first_rank, per_bin)
                bins.append(first_bin + k)
                offsets.append(offset + j * length)
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            return [*own, bins, offsets, *([batch.column("ids")] if keep_ids else [])]

        return step

    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if keep_ids else [])), make, out)
