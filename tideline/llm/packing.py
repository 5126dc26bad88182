"""Best-fit packing of token pieces into sequences of bounded length (large-item matching).

Only the number of pieces of each length matters for a plan, so the plan is made from at most ``capacity`` counts,
whatever the size of the corpus, and is itself bounded by the capacity:

1. pieces above a third of the capacity are *large*; no sequence holds more than two of them. From the longest down,
   each is matched with the longest other large piece that fits, or stays alone;
2. the smaller pieces, from the longest down, go where they fit best: into the sequences with the least sufficient gap;
   when no gap is left, into new sequences.

A plan row says: pieces of this length with ranks ``lo`` to ``hi - 1`` lie at this offset in sequences ``base``,
``base + 1``, ... Ranks within a length come from windows over hashed chunks of it, with chunk totals added, so that a
length that most pieces share is no single task's work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import durable, map_slices, partitions_for
from tideline.llm.tokens import encoder, vocabulary

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut only where longer than the capacity.

    A null text is empty and gives one piece, the end id. A row that repeats gives its pieces again. Other columns of
    ``docs`` are not read.
    """
    vocab = vocab or vocabulary()

    def make():
        encode = encoder(vocab)

        def work(batch, data, offsets):
            ids, bounds = encode.encode(batch.column(1).to_pylist())
            n = len(bounds) - 1
            closed = np.full(len(ids) + n, end_id, np.uint32)
            closed[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
            bounds = bounds + np.arange(n + 1)
            pieces = -(-np.diff(bounds) // capacity)
            row = np.repeat(np.arange(n), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = bounds[row] + piece * capacity
            hi = np.minimum(lo + capacity, bounds[row + 1])
            raw = memoryview(closed.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            return {"doc_id": batch.column(0).take(pa.array(row)), "piece": piece, "start": piece * capacity, "length": hi - lo, "ids_crc32": crc}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", PIECES, make)


class _Bins:
    """Groups of equally filled sequences by their gap; a group is (contents as (length, offset), number)."""

    def __init__(self):
        self.by_gap: dict[int, list] = {}
        self.gaps: list[int] = []

    def add(self, gap: int, contents: tuple, number: int) -> None:
        if not number:
            return
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            insort(self.gaps, gap)
        self.by_gap[gap].append((contents, number))

    def take(self, least: int, most: int):
        """Up to ``most`` sequences of one group with the least gap of at least ``least``: (gap, contents, number)."""
        k = bisect_left(self.gaps, least)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        contents, number = self.by_gap[gap].pop()
        if number > most:
            self.by_gap[gap].append((contents, number - most))
            number = most
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            del self.gaps[k]
        return gap, contents, number


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, base, offset) rows from the number of pieces of each length, 1 to ``capacity``."""
    left = {length: n for length, n in counts.items() if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"lengths must be 1 to {capacity}")
    third = capacity // 3
    bins = _Bins()
    large = sorted(length for length in left if length > third)
    while large:
        top = large[-1]
        k = bisect_left(large, capacity - top + 1) - 1
        if k < 0:
            bins.add(capacity - top, ((top, 0),), left.pop(top))
            large.pop()
            continue
        mate = large[k]
        if mate == top and left[top] == 1:
            mate = large[k - 1] if k else 0
        if not mate:
            bins.add(capacity - top, ((top, 0),), left.pop(top))
            large.pop()
            continue
        number = left[top] // 2 if mate == top else min(left[top], left[mate])
        bins.add(capacity - top - mate, ((top, 0), (mate, top)), number)
        for used in (top, mate):
            left[used] -= number
            if not left[used]:
                del left[used]
                large.remove(used)
    for small in sorted(left, reverse=True):
        n = left[small]
        while n:
            found = bins.take(small, n)
            if found is None:
                each = capacity // small
                full, rest = divmod(n, each)
                for number, inside in ((full, each), (1 if rest else 0, rest)):
                    bins.add(capacity - small * inside, tuple((small, small * i) for i in range(inside)), number)
                break
            gap, contents, number = found
            fit = min(gap // small, n // number)  # the same sequences stay the best fit until they are full
            offset = capacity - gap
            bins.add(gap - fit * small, contents + tuple((small, offset + small * i) for i in range(fit)), number)
            n -= fit * number
    rows, rank, base = [], {}, 0
    for gap in bins.gaps:
        for contents, number in bins.by_gap[gap]:
            for length, offset in contents:
                lo = rank.get(length, 0)
                rows.append((length, lo, lo + number, base, offset))
                rank[length] = lo + number
            base += number
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, each: int = 100_000, least_chunks: int = 32) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``; every piece is placed once.

    Repeated rows are pieces of their own. The counts (at most ``capacity`` rows) and the plan made from them are the
    only data at the driver. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    chunks = max(least_chunks, partitions_for(pieces.count(), each))
    cut = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int"))
    totals = durable(cut.groupBy("length", "_chunk").agg(F.count("*").alias("_n")))
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = np.array(plan_bins(counts, capacity) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("length", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_chunk").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("_in", inside).join(starts, ["length", "_chunk"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_chunk", "_before", "_in")
    shared = spark.sparkContext.broadcast(plan)
    names = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank") + ", sequence_id bigint, offset bigint"

    def place(batches):
        table = shared.value
        span = np.int64(1) << 40  # ranks of one length stay below; lengths are at most the capacity
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(keys, length * span + rank, "right") - 1
            sequence = table[row, 3] + rank - table[row, 1]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(table[row, 4])], names=names + ["sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None) -> DataFrame:
    """Tokenise, cut and pack whole texts: one row per piece with its sequence and place."""
    return pack(durable(token_pieces(docs, capacity, vocab)), capacity)
