"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed stride.

1. Texts are tokenised and cut into sequences of at most ``SEQUENCE`` ids. A first pass only counts the sequences of
   each input split, without making ids; the counts number them 0 to N - 1 in the order of the splits. Ids are not
   stored between the passes: that would take as much disk again as the shards. The driver holds 16 bytes a split
   (13 MB for 100 TB in splits of 128 MB).
2. A keyed Feistel permutation over the next even power of two, walked along its cycles until it falls below N,
   assigns every number a slot of its own in 0 to N - 1. Slots are computed, never stored or shuffled for.
3. Slots are range-partitioned: a partition holds a run of whole shards. Sequences are written there in order, each
   in ``stride`` bytes, so slot s lies in shard s // per_shard at byte (s % per_shard) * stride. A reader goes on from
   any slot by one seek. Ids take two bytes, or four where the vocabulary has more than 65,536.

Shards are written under a temporary name and moved into place, so a task that runs again replaces its own files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import mix, slices, u64
from tideline.llm.tokens import encoder, vocabulary

SEQUENCE = 512
PER_SHARD = 16_384
END_ID = 0
ROUNDS = 6


def id_type(vocab: str | None = None) -> np.dtype:
    """The stored width of an id: two bytes where every id of the vocabulary fits, else four."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(vocab or vocabulary()).get_vocab_size() <= 1 << 16 else "<u4")


class Feistel:
    """A keyed permutation of 0 to n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [int(mix(np.array([(key * ROUNDS + r) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        mask, half = u64((1 << self.half) - 1), u64(self.half)
        left, right = x >> half, x & mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (mix(left + u64(k)) & mask), left
            else:
                left, right = right, left ^ (mix(right + u64(k)) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), back)
        while (out := x >= u64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _by_split(docs: DataFrame) -> DataFrame:
    split = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), split.alias("split"))


def _runs(split: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1).tolist(), len(split)]
    return ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def count_sequences(docs: DataFrame, length: int = SEQUENCE, vocab: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the input splits in ascending order, and their numbers of sequences. ``docs`` must be read from files."""
    vocab = vocab or vocabulary()

    def run(batches):
        encode = encoder(vocab)
        total: dict[int, int] = {}
        for batch in batches:
            for a, b, _, _ in slices(batch.column("text")):
                rows = batch.slice(a, b - a)
                pieces = encode.counts(rows.column("text").to_pylist()) // length + 1  # with the end id, rounded up
                split = rows.column("split").to_numpy()
                for lo, hi in _runs(split):
                    total[int(split[lo])] = total.get(int(split[lo]), 0) + int(pieces[lo:hi].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["split", "n"])

    counts = _by_split(docs).mapInArrow(run, "split bigint, n bigint").groupBy("split").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(counts["split"].to_numpy())
    return counts["split"].to_numpy()[order], counts["n"].to_numpy()[order]


def sequences(docs: DataFrame, counts: tuple[np.ndarray, np.ndarray], key: int, length: int = SEQUENCE, vocab: str | None = None) -> DataFrame:
    """(slot, doc_id, piece, ids): every sequence with its slot. An executor that runs a split again gives the same rows."""
    vocab = vocab or vocabulary()
    kind = id_type(vocab)
    total = int(counts[1].sum())
    shared = docs.sparkSession.sparkContext.broadcast((counts[0], np.cumsum(counts[1]) - counts[1]))

    def run(batches):
        encode = encoder(vocab)
        splits, begins = shared.value
        order = Feistel(total, key)
        used: dict[int, int] = {}
        for batch in batches:
            for a, b, _, _ in slices(batch.column("text")):
                rows = batch.slice(a, b - a)
                ids, bounds = encode.encode(rows.column("text").to_pylist())
                n = len(bounds) - 1
                closed = np.full(len(ids) + n, END_ID, kind)
                closed[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
                bounds = bounds + np.arange(n + 1)
                pieces = -(-np.diff(bounds) // length)
                split = rows.column("split").to_numpy()
                number = np.zeros(int(pieces.sum()), np.int64)
                at = np.concatenate([[0], np.cumsum(pieces)])
                for lo, hi in _runs(split):
                    own = int(split[lo])
                    first = used.get(own, int(begins[np.searchsorted(splits, own)]))
                    number[at[lo] : at[hi]] = first + np.arange(at[hi] - at[lo])
                    used[own] = first + int(at[hi] - at[lo])
                row = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(row)) - at[:-1][row]
                lo = bounds[row] + piece * length
                hi = np.minimum(lo + length, bounds[row + 1])
                # pieces follow each other, so they are one Arrow buffer and its offsets
                offsets = np.concatenate([lo, hi[-1:]]) * kind.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(closed)])
                yield pa.RecordBatch.from_arrays([pa.array(order.slot(number)), rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), packed], names=["slot", "doc_id", "piece", "ids"])

    return _by_split(docs).mapInArrow(run, "slot bigint, doc_id bigint, piece int, ids binary")


def write_shards(rows: DataFrame, folder: str, shards: int, kind: np.dtype, length: int = SEQUENCE, per_shard: int = PER_SHARD, partitions: int | None = None) -> DataFrame:
    """Write (slot, doc_id, piece, ids) rows as ``shards`` shards and return where each went: the manifest.

    ``folder``: a URI that all executors reach. The rows are evaluated, and the shards written, when the manifest is;
    reading it again writes the same shards again, so store it. ``partitions``: at most, runs of equally many shards.
    """
    stride, width = length * kind.itemsize, kind.itemsize
    context = rows.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()  # with its scheme

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        shard, held = None, []

        def close():
            final, temporary = f"{base}/shard-{shard:08d}.bin", f"{base}/_{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                for ids in held:
                    out.write(ids + bytes(stride - len(ids)))
            store.move(temporary, final)

        for batch in batches:
            slots = batch.column("slot").to_numpy()
            raw = batch.column("ids").to_pylist()
            for s, ids in zip((slots // per_shard).tolist(), raw, strict=True):
                if s != shard:
                    if held:
                        close()
                    shard, held = s, []
                held.append(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("doc_id"), batch.column("piece"), pa.array(slots // per_shard), pa.array(slots % per_shard * stride), pa.array([len(i) // width for i in raw], pa.int64()), pa.array([zlib.crc32(i) for i in raw], pa.int64())],
                names=["slot", "doc_id", "piece", "shard", "at_byte", "length", "crc32"],
            )
        if held:
            close()

    partitions = min(partitions or shards, max(shards, 1))
    run_of = F.expr(f"cast((slot div {per_shard}) * {partitions} div {max(shards, 1)} as int)")
    ordered = rows.repartitionById(partitions, run_of).sortWithinPartitions("slot")
    return ordered.mapInArrow(run, "slot bigint, doc_id bigint, piece int, shard bigint, at_byte bigint, length bigint, crc32 bigint")


def materialise(docs: DataFrame, folder: str, key: int = 1, length: int = SEQUENCE, per_shard: int = PER_SHARD, vocab: str | None = None) -> DataFrame:
    """Tokenise ``docs`` (read from files), write the shards to ``folder`` and return the manifest, one row per sequence.

    A null or empty text is one sequence, the end id. Rows that repeat are sequences of their own. An empty table
    gives no shard and no row.
    """
    counts = count_sequences(docs, length, vocab)
    shards = -(-max(1, int(counts[1].sum())) // per_shard)
    return write_shards(sequences(docs, counts, key, length, vocab), folder, shards, id_type(vocab), length, per_shard)


def read_slots(folder: str, begin: int, end: int, length: int = SEQUENCE, per_shard: int = PER_SHARD, kind: np.dtype = np.dtype("<u2")) -> Iterator[np.ndarray]:
    """The stored ids (zeros up to the stride) of slots ``begin`` to ``end - 1``, shard by shard in order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    stride = length * kind.itemsize
    while begin < end:
        shard, row = divmod(begin, per_shard)
        n = min(end - begin, per_shard - row)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as source:
            source.seek(row * stride)
            raw = source.read(n * stride)
        yield from np.frombuffer(raw, kind).reshape(n, length)
        begin += n


def slot_order(spark: SparkSession, n: int, key: int = 1) -> DataFrame:
    """(number, slot) of all sequence numbers, for inspection; ``spark.range`` deals it out."""
    def run(batches):
        order = Feistel(n, key)
        for batch in batches:
            number = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(order.slot(number))], names=["number", "slot"])

    return spark.range(n).mapInArrow(run, "number bigint, slot bigint")
