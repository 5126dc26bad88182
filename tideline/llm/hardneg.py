"""Hard-negative mining: Strassen products of int64 anchor and candidate tiles, kept in mergeable heaps.

1. Components become whole numbers, ``floor(scale * x)``. Anchors are dealt to tiles and candidates to parts, both of
   bounded size; a cell is one tile with one part. A row goes once to each cell of its tile or part, and each cell is a
   stream of its own: the tile first, then the part's rows in Arrow batches.
2. In a cell, scores come from Strassen's recursion on zero-padded int64 tiles. Its sums and differences wrap modulo
   2^64, so every score that fits 64 bits is exact, whatever the steps between.
3. A first run over the cells keeps each anchor's best rows of its own label in a bounded heap, a second one for each
   (anchor, positive) the best rows of other labels whose score lies in the positive's window. The heaps of an anchor's
   cells merge after a shuffle that carries at most the heap size a cell.

Every anchor meets every row: that is the definition, so work grows with anchors times rows, in cells that any number
of machines can share. A task holds one tile, one batch and the heaps of the tile, never a group of rows.

Edges: rows without id or label, without vector, or with a missing or non-finite component take no part. Shorter vectors
count as zero beyond their end. Whole numbers are bounded so that an inner product fits 64 bits (about 3.8e8 at 64
components); larger ones stand as the bound. Repeated rows are rows of their own, as anchors, positives and negatives.
Order: higher scores first, then smaller ids. An empty table, and an anchor without positive, give no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import durable

#: Side below which a product is taken directly; rows of a tile multiplied at a time; anchors a tile; rows a part.
LEAF, STRIP, TILE, PART = 32, 1024, 16_384, 8_192
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of small int64 tiles; in doubles where every partial sum is a whole number below 2^53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    for k in range(a.shape[1]):
        out += a[:, k : k + 1] * b[k : k + 1]
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64 tiles of any shape, modulo 2^64: seven half-size products a level."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _direct(a, b)
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((2 * i, 2 * l), np.int64)
    c11, c12, c21, c22 = out[:i, :l], out[:i, l:], out[i:, :l], out[i:, l:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


class Heaps:
    """For each of ``rows`` the ``most`` best (score, id), higher scores first, then smaller ids."""

    def __init__(self, rows: int, most: int):
        self.most = most
        self.score = np.full((rows, most), NONE)
        self.id = np.full((rows, most), MOST)

    def floor(self) -> np.ndarray:
        """The score below which nothing enters; ties may."""
        return self.score[:, -1]

    def push(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Add entries; also merges another heap, whose entries they are."""
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        held = np.repeat(np.arange(len(touched)), self.most)
        row = np.concatenate([held, row])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, ~score, row))  # ~x falls as x grows, also for the least value
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.most
        self.score[touched[row[keep]], rank[keep]] = score[keep]
        self.id[touched[row[keep]], rank[keep]] = ids[keep]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.score != NONE)
        return row, self.score[row, place], self.id[row, place]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as int64 rows, zero beyond the end of a shorter list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    if (length == width).all():
        return flat.reshape(len(length), width)
    out = np.zeros((len(length), width), np.int64)
    out[np.arange(width) < length[:, None]] = flat
    return out


def whole_numbers(vector: Column, scale: int, limit: int) -> Column:
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(2.0**40)), F.lit(-(2.0**40)))), F.lit(limit)), F.lit(-limit)).cast("int"))


def finite(vector: Column) -> Column:
    """A vector is there, and so are all its components, as finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def _cells(rows: DataFrame, anchors: DataFrame, tiles: int, parts: int) -> DataFrame:
    """All rows of a cell in one partition, the tile's anchors before the part's rows."""
    spread = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("tile", spread(tiles)).withColumn("part", many(parts)).withColumn("side", F.lit(0))
    b = rows.withColumn("part", spread(parts)).withColumn("tile", many(tiles)).withColumn("side", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.repartition(tiles * parts, "tile", "part").sortWithinPartitions("tile", "part", "side")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Pieces of the batches that hold one side of one cell."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("tile", "part", "side")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield tuple(keys[:, lo].tolist()), batch.slice(lo, hi - lo)


class _Tile:
    """The anchors of a cell, and the heaps that its rows fill."""

    def __init__(self, pieces: list[pa.RecordBatch], width: int):
        rows = pa.Table.from_batches(pieces).combine_chunks()
        self.rows = rows
        self.x = matrix(rows.column("x"), width)
        self.uid, self.label = rows.column("uid").to_numpy(), rows.column("label").to_numpy()

    def scores(self, piece: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first anchor, anchor after the last, scores) strip by strip."""
        other = np.ascontiguousarray(matrix(piece.column("x"), width).T)
        for lo in range(0, len(self.x), STRIP):
            hi = min(lo + STRIP, len(self.x))
            yield lo, hi, strassen(self.x[lo:hi], other)


def _worker(width: int, heaps_of, offer, emit):
    """The Arrow function of a run over the cells: ``offer`` fills the tile's heaps, ``emit`` gives them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pieces, tile, heaps = None, [], None, None
        for (*key, side), piece in _runs(batches):
            if key != cell:
                if tile is not None:
                    yield emit(tile, heaps)
                cell, pieces, tile = key, [], None
            if side == 0:
                pieces.append(piece)
                continue
            if not pieces:
                continue
            if tile is None:
                tile = _Tile(pieces, width)
                heaps = heaps_of(tile)
            offer(tile, heaps, piece)
        if tile is not None:
            yield emit(tile, heaps)

    return run


def positives(rows: DataFrame, anchors: DataFrame, width: int, tiles: int, parts: int, most: int) -> DataFrame:
    """(uid, place, positive_id, positive_score): each anchor's first ``most`` other rows of its label, place from 0."""

    def offer(tile, heaps, piece):
        uid, label, ids = (piece.column(c).to_numpy() for c in ("uid", "label", "vec_id"))
        for lo, hi, score in tile.scores(piece, width):
            wanted = (score >= heaps.floor()[lo:hi, None]) & (tile.label[lo:hi, None] == label) & (tile.uid[lo:hi, None] != uid)
            row, col = np.nonzero(wanted)
            heaps.push(row + lo, score[row, col], ids[col])

    def emit(tile, heaps):
        row, score, ids = heaps.entries()
        return pa.RecordBatch.from_arrays([pa.array(tile.uid[row]), pa.array(ids), pa.array(score)], names=["uid", "positive_id", "positive_score"])

    found = _cells(rows, anchors, tiles, parts).mapInArrow(_worker(width, lambda tile: Heaps(len(tile.x), most), offer, emit), "uid bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < most)


def negatives(rows: DataFrame, anchors: DataFrame, width: int, tiles: int, parts: int, most: int) -> DataFrame:
    """(uid, place, rank, negative_id, negative_score) for anchors with the array ``window`` of (place, low, high)."""

    def heaps_of(tile):
        windows = tile.rows.column("window").to_pylist()
        slots = 1 + max((w["place"] for ws in windows for w in ws), default=0)
        tile.low = np.full((slots, len(windows)), MOST)
        tile.high = np.full((slots, len(windows)), NONE)
        for i, ws in enumerate(windows):
            for w in ws:
                tile.low[w["place"], i], tile.high[w["place"], i] = w["low"], w["high"]
        return [Heaps(len(windows), most) for _ in range(slots)]

    def offer(tile, heaps, piece):
        label, ids = (piece.column(c).to_numpy() for c in ("label", "vec_id"))
        for lo, hi, score in tile.scores(piece, width):
            score[tile.label[lo:hi, None] == label] = NONE
            for heap, low, high in zip(heaps, tile.low, tile.high, strict=True):
                least = np.maximum(low[lo:hi], heap.floor()[lo:hi])
                row, col = np.nonzero((score >= least[:, None]) & (score <= high[lo:hi, None]))
                heap.push(row + lo, score[row, col], ids[col])

    def emit(tile, heaps):
        found = [(np.full(len(row), place, np.int32), tile.uid[row], score, ids) for place, heap in enumerate(heaps) for row, score, ids in [heap.entries()]]
        place, uid, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(place), pa.array(ids), pa.array(score)], names=["uid", "place", "negative_id", "negative_score"])

    found = _cells(rows, anchors, tiles, parts).mapInArrow(_worker(width, heaps_of, offer, emit), "uid bigint, place int, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, scale: int = 256, tile: int = TILE, part: int = PART
) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, embedding, label) for which ``is_anchor`` holds.

    A negative of a positive scores from 50 to 95 hundredths of it. Result: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("e"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("e")))
    width = kept.agg(F.max(F.size("e"))).first()[0] or 0
    limit = min(2**31 - 1, math.isqrt((2**63 - 1) // max(1, width)))
    # written once: the row numbers must be the same in both runs
    rows = durable(kept.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "is_anchor", whole_numbers(F.col("e"), scale, limit).alias("x")))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a")).first()
    parts, tiles = max(1, -(-counts["n"] // part)), max(1, -(-counts["a"] // tile))
    anchors = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    best = durable(positives(rows, anchors, width, tiles, parts, n_positives))
    # half of the positive's score rounded up, 19 twentieths of it rounded down, without products that could overflow
    low, high = F.expr("positive_score - (positive_score - pmod(positive_score, 2)) div 2"), F.expr("positive_score - (positive_score + pmod(-positive_score, 20)) div 20")
    windows = best.groupBy("uid").agg(F.collect_list(F.struct("place", low.alias("low"), high.alias("high"))).alias("window"))
    found = negatives(rows, anchors.join(windows, "uid"), width, tiles, parts, n_negatives)
    named = found.join(best, ["uid", "place"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
