"""N-gram Jaccard join: documents whose shingle sets have a similarity of at least the threshold, and their components.

1. *Sketch.* One pass counts all shingles into a fixed array of cells (summed block by block) and gives each text its
   number of shingles and its class, a 64-bit digest of its set: equal sets are one class from here on.
2. *Global order.* A shingle's key is the level of its cell's count (eight levels to a doubling), then its hash: common
   shingles come last. Any order that depends on the shingle alone gives the same result; this one keeps passages that
   many texts share out of prefixes.
3. *Prefixes.* Two sets that are similar enough share one of their first n - ceil(t n) + 1 keys. Classes that share
   such a key, and have no gap between their sizes that the threshold forbids, meet in the block of the smallest of
   them, once, however many keys they share.
4. *Signatures.* Blocks first see a bitmap of each set, a few bits per shingle. A bit that one set has and another lacks
   stands for a shingle that is not shared, which bounds the overlap from above; who has no partner within the bound
   leaves the block. Whole sets, forty times as large, are then sent for the rest only.
5. *Trie join.* A block's sets, as ordered key sequences, form a trie. For each set the trie is walked level by level:
   the overlap of a path is counted once for all sets below it, and a subtree is left out when its sizes cannot fit,
   when the keys that remain on either side cannot make up the missing overlap, or when all its sets are linked with
   the set already. Overlaps are counted exactly.
6. Links found in blocks span each block's components; star contractions make the whole ones.

Large blocks are cut into parts whose pairs are joined one by one. Hashes are 64-bit: two given sets of a thousand
shingles confuse any two of them with a chance below 1e-12.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Words, durable, look_up, lowered, mix, slices, u64
from tideline.llm.components import components

WORDS = 5
PERCENT = 75
#: Cells of the sketch, as a power of two: four bytes each at the driver, one in the broadcast. Over a few hundred
#: shingles a cell, more bits keep rarer passages apart.
SKETCH_BITS = 23
BLOCKS = 64
LIVE_BITS = 26
#: Postings of a bucket, keys of one side of a block pair, and the count level from which a key's postings are spread
#: over tasks (8 * 17: a count of 2^17).
BUCKET_POSTINGS = 500_000
PART_KEYS = 2_000_000
#: Sets that a part of a block holds at most: those that meet are compared in one task.
PART_SETS = 8192
LEVELS = 8
HEAVY = LEVELS * 17
HASH_BITS = 56
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_Q = [u64(pow(0x2545F4914F6CDD1D, j + 1, 1 << 64)) for j in range(WORDS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the distinct hashes, in order, of its 5-word shingles; of fewer words, of the whole sequence."""
    words = Words(lowered(data), offsets, _WORD)
    h, first = words.hash, words.first
    count = np.diff(first)
    n = len(h)
    whole = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for j in range(WORDS):
        whole = whole + h[j : n - WORDS + 1 + j] * _Q[j]
    whole = mix(whole)
    short = np.zeros(len(count), np.uint64)
    for j in range(WORDS - 1):
        has = (count > j) & (count < WORDS)
        short[has] += h[first[:-1][has] + j] * _Q[j]
    short = mix(short + count.astype(np.uint64))
    out = []
    for i, (a, c) in enumerate(zip(first[:-1].tolist(), count.tolist(), strict=True)):
        out.append(np.unique(whole[a : a + c - WORDS + 1]) if c >= WORDS else short[i : i + (c > 0)])
    return out


def digest(shingles: np.ndarray) -> int:
    """The class of a set: a signed 64-bit digest of its shingles and their number."""
    total = mix(mix(shingles ^ u64(0x6A09E667F3BCC909)).sum(keepdims=True) + u64(len(shingles)))
    return int(total.view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def row_key(docs: DataFrame) -> Column:
    """64 bits of a row's doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))


def _per_task(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run(parts)`` over a task's texts, where a part is (rows of doc_id, row and text; their sets)."""

    def task(batches):
        def parts():
            for batch in batches:
                for a, b, data, offsets in slices(batch.column("text"), 1 << 20):
                    yield batch.slice(a, b - a), shingle_sets(data, offsets)

        yield from run(parts())

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.select("doc_id", row_key(narrow).alias("row"), "text").mapInArrow(task, schema)


def _counted(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, n, cls) of all texts, and after them rows (block, counts) of the task's sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(parts):
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for rows, sets in parts:
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            slot, times = np.unique(flat >> u64(64 - SKETCH_BITS), return_counts=True)
            cells[slot.astype(np.int64)] += times.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=schema)
        blocks = [zlib.compress(b.tobytes(), 1) for b in cells.reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, pa.int64())] * 4 + [pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], schema=schema)

    return _per_task(docs, run, "doc_id bigint, row bigint, n bigint, cls bigint, block int, counts binary")


def _summed(blocks: DataFrame, dtype, combine) -> np.ndarray:
    """Blocks of compressed arrays combined element by element; the result has a fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for raw in table.column("counts").to_pylist():
            part = np.frombuffer(zlib.decompress(raw), dtype)
            total = part.copy() if total is None else combine(total, part)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = blocks.groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), dtype) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(0, dtype)


def _saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.uint64) + b, 0xFFFFFFFF).astype(np.uint32)


def count_levels(sketch: np.ndarray) -> np.ndarray:
    parts = [np.floor(LEVELS * np.log2(np.maximum(part, 1).astype(np.float32))).clip(0, 255).astype(np.uint8) for part in sketch.reshape(BLOCKS, -1)]
    return np.concatenate(parts)


def ordered_keys(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's keys in the global order: the level of the shingle's cell, then its hash."""
    common = levels[(shingles >> u64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((common << u64(HASH_BITS)) | (shingles & u64((1 << HASH_BITS) - 1)))


def size_level(n: int, percent: int) -> int:
    """A level of a set's size: sizes that may be similar are at most LEVELS apart; 255 stands for all above."""
    return min(255, int(LEVELS * np.log(n) / np.log(100 / percent))) if percent < 100 else 0


def _postings(docs: DataFrame, levels, buckets: int, percent: int, heavy: int) -> DataFrame:
    """(bucket, spread, keys, classes, sizes): the prefix keys of every class, packed; ``spread`` marks heavy keys."""
    schema = pa.schema([("bucket", pa.int32()), ("spread", pa.bool_()), ("keys", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary())])

    def run(parts):
        seen: set[int] = set()
        for _, sets in parts:
            keys, classes, sizes = [], [], []
            for s in sets:
                if not len(s):
                    continue
                cls = digest(s)
                if cls in seen:
                    continue
                seen.add(cls)
                prefix = ordered_keys(s, levels.value)[: prefix_length(len(s), percent)]
                keys.append(prefix)
                classes.append(np.full(len(prefix), cls, np.int64))
                sizes.append(np.full(len(prefix), size_level(len(s), percent), np.uint8))
            if not keys:
                continue
            key, cls, size = np.concatenate(keys), np.concatenate(classes), np.concatenate(sizes)
            wide = (key >> u64(HASH_BITS)) >= u64(heavy)
            # a heavy key's postings go by class as well, so that no bucket gets all of them
            slot = mix(np.where(wide, key ^ mix(cls.view(np.uint64)), key)) % u64(buckets)
            group = slot.astype(np.int64) * 2 + wide
            order = np.argsort(group, kind="stable")
            key, cls, size, group = key[order], cls[order], size[order], group[order]
            places = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            spans = list(zip(places[:-1].tolist(), places[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(group[a]) // 2 for a, _ in spans], pa.int32()), pa.array([bool(group[a] % 2) for a, _ in spans]), pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([cls[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([size[a:b].tobytes() for a, b in spans], pa.binary())], schema=schema)

    return _per_task(docs, run, "bucket int, spread boolean, keys binary, classes binary, sizes binary")


def _shared_keys(postings: DataFrame) -> DataFrame:
    """(rep, cls): of the classes that share a prefix key, each with the smallest; or (key, cls) for a heavy key."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("cls", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        wide = np.array(table.column("spread").to_pylist())
        keys, classes, sizes = (table.column(c).to_pylist() for c in ("keys", "classes", "sizes"))
        made = []
        for mark in (False, True):
            rows = np.flatnonzero(wide == mark)
            if not len(rows):
                continue
            key = np.frombuffer(b"".join(keys[i] for i in rows), np.uint64)
            cls = np.frombuffer(b"".join(classes[i] for i in rows), np.int64)
            level = np.frombuffer(b"".join(sizes[i] for i in rows), np.uint8)
            order = np.lexsort((cls, level, key))
            key, cls, level = key[order], cls[order], level[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, level = key[fresh], cls[fresh], level[fresh].astype(int)
            if mark:
                made.append((key.view(np.int64), np.full(len(key), -1), cls, False))
                continue
            # a run ends with its key, or where the next size is too far above (nothing across is similar enough)
            far = (level[1:] - level[:-1] > LEVELS + 1) & (level[1:] < 255)  # one more for rounding
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | far]))
            size = np.diff(np.concatenate([begin, [len(key)]]))
            begin, size = begin[size > 1], size[size > 1]
            least = np.minimum.reduceat(np.append(cls, np.iinfo(np.int64).max), np.stack([begin, begin + size], 1).ravel())[::2] if len(begin) else cls[:0]
            rep = np.repeat(least, size)
            own = cls[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            pair = np.unique(np.stack([rep, own]), axis=1) if len(rep) else np.zeros((2, 0), np.int64)
            made.append((None, pair[0], pair[1], True))
        tables = [pa.table([pa.nulls(len(own), pa.int64()) if light else pa.array(key), pa.array(rep) if light else pa.nulls(len(own), pa.int64()), pa.array(own)], schema=schema) for key, rep, own, light in made]
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return postings.groupBy("bucket").applyInArrow(meet, "key bigint, rep bigint, cls bigint")


def _members(shared: DataFrame) -> DataFrame:
    """Distinct (rep, cls): the members of each block, its representative among them."""
    heavy = shared.where("key IS NOT NULL").select("key", "cls")
    least = heavy.groupBy("key").agg(F.min("cls").alias("rep"), F.count("*").alias("n")).where("n > 1").select("key", "rep")
    light = shared.where("key IS NULL").select("rep", "cls")
    return light.unionByName(look_up(heavy, least, "key", "cls").select("rep", "cls")).distinct()


def _live_bits(members: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for every class that is in a block."""

    def run(batches):
        bits = np.zeros(1 << (LIVE_BITS - 3), np.uint8)
        for batch in batches:
            slot = mix(batch.column("cls").to_numpy().view(np.uint64)) >> u64(64 - LIVE_BITS)
            np.bitwise_or.at(bits, (slot >> u64(3)).astype(np.int64), np.left_shift(1, (slot & u64(7)).astype(np.uint8)).astype(np.uint8))
        blocks = bits.reshape(BLOCKS, -1)
        some = [i for i in range(BLOCKS) if blocks[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary())], names=["block", "counts"])

    parts = members.select("cls").mapInArrow(run, "block int, counts binary")
    full = np.zeros((BLOCKS, 1 << (LIVE_BITS - 3)), np.uint8).reshape(BLOCKS, -1)[:, : (1 << (LIVE_BITS - 3)) // BLOCKS].copy()

    def add(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(raw), np.uint8) for raw in table.column("counts").to_pylist()])
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    for r in parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        full[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return full.ravel()


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of a set: bit h mod 2^k of each shingle h, where 2^k is at least twice the set's size and 64."""
    bits = np.zeros(max(64, 1 << int(2 * len(shingles) - 1).bit_length()), bool)
    bits[(shingles & u64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (one a row) of half the length, again and again down to ``size`` bytes: of the same sets."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def partners(sizes: np.ndarray, signatures: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set whether another one may be similar enough: no pair that is can be missed.

    The sets are compared in the order of their sizes, each with the larger ones that the threshold allows.
    """
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    length = np.array([len(signatures[i]) for i in order])
    for own in np.unique(length).tolist():
        at = np.flatnonzero(length == own)
        by_length[own] = at, np.stack([signatures[order[i]] for i in at])
    found = np.zeros(len(n), bool)
    for x in range(len(n)):
        mine = signatures[order[x]][None, :]
        top = 100 * n[x] // percent
        for own, (at, bits) in by_length.items():
            lo, hi = np.searchsorted(at, x + 1), np.searchsorted(n[at], top, "right")
            while lo < hi and not (found[x] and found[at[lo:hi]].all()):
                end = min(hi, lo + 512)
                size = min(own, mine.shape[1])
                a, b = _folded(mine, size), _folded(bits[lo:end], size)
                rest = np.minimum(n[x] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n[at[lo:end]] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
                hit = 100 * rest >= percent * (n[x] + n[at[lo:end]] - rest)
                found[at[lo:end][hit]] = True
                found[x] |= hit.any()
                lo = end
    out = np.zeros(len(n), bool)
    out[order] = found
    return out


def _live_sets(docs: DataFrame, levels, live, whole: bool) -> DataFrame:
    """(cls, n, keys) of the classes whose bit is set, once per task at most: whole ordered sets, or signatures."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])

    def run(parts):
        seen: set[int] = set()
        for _, sets in parts:
            classes, sizes, keys = [], [], []
            digests = np.array([digest(s) if len(s) else 0 for s in sets], np.int64)
            slot = mix(digests.view(np.uint64)) >> u64(64 - LIVE_BITS)
            on = (live.value[(slot >> u64(3)).astype(np.int64)] >> (slot & u64(7)).astype(np.uint8)) & 1
            for s, cls, hit in zip(sets, digests.tolist(), on.tolist(), strict=True):
                if hit and len(s) and cls not in seen:
                    seen.add(cls)
                    classes.append(cls)
                    sizes.append(len(s))
                    keys.append((ordered_keys(s, levels.value) if whole else signature(s)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], schema=schema)

    made = _per_task(docs, run, "cls bigint, n bigint, keys binary")
    return made.groupBy("cls").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


class Trie:
    """The trie of ordered key sequences, edges joined where they do not branch.

    Nodes have a parent, a depth, the range of sequences below (in lexicographic order), the least and greatest number
    of keys among them, and the sequence that ends there, or -1. A node's label is the part of its first sequence
    between its parent's depth and its own.
    """

    def __init__(self, sequences: list[np.ndarray]):
        distinct, flat = np.unique(np.concatenate(sequences), return_inverse=True)
        self.width = len(distinct)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
        parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        raw = [p.astype(">u4").tobytes() for p in parts]
        self.order = sorted(range(len(parts)), key=raw.__getitem__)
        self.sets = [parts[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets])
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.concatenate(self.sets)
        parent, depth, lo, hi, ends = [-1], [0], [0], [len(parts)], [-1]
        stack = [0]
        for i, own in enumerate(self.sets):
            same = 0
            if i:
                other = self.sets[i - 1]
                m = min(len(own), len(other))
                differ = np.flatnonzero(own[:m] != other[:m])
                same = int(differ[0]) if len(differ) else m
            while depth[stack[-1]] > same:
                node = stack.pop()
                hi[node] = i
                if depth[stack[-1]] < same:
                    parent.append(stack[-1]), depth.append(same), lo.append(lo[node]), hi.append(-1), ends.append(-1)
                    parent[node] = len(parent) - 1
                    stack.append(parent[node])
            parent.append(stack[-1]), depth.append(len(own)), lo.append(i), hi.append(-1), ends.append(i)
            stack.append(len(parent) - 1)
        for node in stack:
            hi[node] = len(parts)
        self.parent, self.depth, self.lo, self.hi, self.ends = map(np.array, (parent, depth, lo, hi, ends))
        self.least = np.array([self.size[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)])
        self.most = np.array([self.size[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)])
        by = np.argsort(self.parent[1:], kind="stable") + 1
        self.children = by
        self.child_at = np.searchsorted(self.parent[by], np.arange(len(parent) + 1))
        self.label_at = self.bounds[self.lo] + np.where(self.parent >= 0, self.depth[self.parent], 0)
        self.label_end = self.bounds[self.lo] + self.depth


class Groups:
    """Components of the sets of a block, numbered by one of them; the smaller one takes the other's name."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members: dict[int, np.ndarray] = {}
        self._runs: np.ndarray | None = None

    def join(self, x: int, y: int) -> bool:
        """Whether two sets were in different components, which are then one."""
        a, b = int(self.of[x]), int(self.of[y])
        if a == b:
            return False
        own, other = self.members.pop(a, np.array([a])), self.members.pop(b, np.array([b]))
        if len(own) > len(other):
            a, b, own, other = b, a, other, own
        self.of[own] = b
        self.members[b] = np.concatenate([other, own])
        self._runs = None
        return True

    def runs(self) -> np.ndarray:
        """For each place the first place after it where another component stands, and one end more."""
        if self._runs is None:
            n = len(self.of)
            edge = np.concatenate([np.flatnonzero(self.of[1:] != self.of[:-1]) + 1, [n]])
            self._runs = np.append(edge[np.searchsorted(edge, np.arange(n), "right")], n)
        return self._runs


class Block:
    """The sets of a block, ready for the walk.

    Keys that only one set has are in no overlap, so the trie holds the other keys; sizes count all. Sets with the same
    other keys, such as copies that differ in a word each, are one *bundle*: one path of the trie, members by size.
    """

    def __init__(self, sequences: list[np.ndarray], percent: int):
        self.percent, self.links = percent, []
        sizes = np.array([len(s) for s in sequences])
        _, number, count = np.unique(np.concatenate(sequences), return_inverse=True, return_counts=True)
        shared = count[number] > 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        bundles: dict[bytes, list[int]] = {}
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            kept = number[lo:hi][shared[lo:hi]]
            if len(kept):
                bundles.setdefault(kept.astype(np.int64).tobytes(), []).append(i)
        self.trie = Trie([np.frombuffer(k, np.int64) for k in bundles]) if bundles else None
        if self.trie is None:
            return
        members = list(bundles.values())
        members = [sorted(members[i], key=lambda j: sizes[j]) for i in self.trie.order]
        self.sets = np.concatenate(members)  # by bundle, then by size
        self.size = sizes[self.sets]
        self.at = np.concatenate([[0], np.cumsum([len(m) for m in members])])
        self.small, self.large = self.size[self.at[:-1]], self.size[self.at[1:] - 1]
        self.least = np.array([self.small[a:b].min() for a, b in zip(self.trie.lo, self.trie.hi, strict=True)])
        self.most = np.array([self.large[a:b].max() for a, b in zip(self.trie.lo, self.trie.hi, strict=True)])
        self.groups = Groups(len(self.sets))
        for i, keys in enumerate(self.trie.sets):
            self.link(i, i, len(keys))

    def limit(self, overlap: np.ndarray | int) -> np.ndarray | int:
        """The greatest sum of two sizes that such an overlap links."""
        return overlap + 100 * overlap // self.percent

    def link(self, x: int, y: int, overlap: int) -> None:
        """Join the sets of two bundles (or of one) that their overlap links: all of them by way of the smallest ones."""
        top = self.limit(overlap)
        first, other = int(self.at[x]), int(self.at[y])
        for own, mate in ((first, y), (other, x)):
            stop = int(np.searchsorted(self.size[self.at[mate] : self.at[mate + 1]], top - self.size[own], "right")) + int(self.at[mate])
            for k in range(int(self.at[mate]), stop):
                if k != own and self.groups.join(own, k):
                    self.links.append((int(self.sets[own]), int(self.sets[k])))
            if x == y:
                break

    def settled(self, x: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether bundle x and all bundles from lo to hi are one component already."""
        runs, begin = self.groups.runs(), int(self.at[x])
        if runs[begin] < self.at[x + 1]:
            return np.zeros(len(lo), bool)
        return (self.groups.of[self.at[lo]] == self.groups.of[begin]) & (runs[self.at[lo]] >= self.at[hi])


#: Bundles that are compared with all others of a block before its trie is walked, at most.
PIVOTS = 64


def _pivot_links(block: Block) -> None:
    """Link some bundles with all others: in a group of near copies these settle most of it. What they leave open is for
    the walk, so their choice changes time only."""
    trie = block.trie
    n = len(trie.sets)
    mark, settled = np.zeros(trie.width, bool), np.zeros(n, bool)
    for _ in range(min(PIVOTS, n // 8)):
        rest = np.flatnonzero(~settled)
        if not len(rest):
            break
        x = int(rest[len(rest) // 2])
        mark[trie.sets[x]] = True
        overlap = np.add.reduceat(mark[trie.flat].astype(np.int64), trie.bounds[:-1])
        mark[trie.sets[x]] = False
        near = np.flatnonzero(block.small[x] + block.small <= block.limit(overlap))
        for y in near[near != x].tolist():
            block.link(x, y, int(overlap[y]))
        fresh = int((~settled[near]).sum())
        settled[near] = settled[x] = True
        if fresh * 100 < n:
            break


def block_links(sequences: list[np.ndarray], percent: int, lot: int = 1 << 17) -> list[tuple[int, int]]:
    """Links that span the components of the sets: every linked pair is joined by them, directly or by others.

    The bundles are walked against the trie of all, each against those before it in lexicographic order. Subtrees that
    are in the walking bundle's component already are left out as a whole. ``lot``: keys looked at in one step.
    """
    block = Block(sequences, percent)
    trie = block.trie
    if trie is None:
        return []
    _pivot_links(block)
    mark = np.zeros(trie.width, bool)
    for x in range(1, len(trie.sets)):
        own, small, large = trie.sets[x], int(block.small[x]), int(block.large[x])
        waiting = [(trie.children[trie.child_at[0] : trie.child_at[1]], np.zeros(trie.child_at[1] - trie.child_at[0], np.int64))]
        marked = False
        while waiting:
            nodes, had = waiting.pop()
            # sizes that fit, bundles before this one, and not all linked with it already
            lo = trie.lo[nodes]
            keep = (lo < x) & (block.most[nodes] * 100 >= percent * small) & (block.least[nodes] * percent <= 100 * large)
            nodes, had, lo = nodes[keep], had[keep], lo[keep]
            keep = ~block.settled(x, lo, np.minimum(trie.hi[nodes], x))
            nodes, had = nodes[keep], had[keep]
            if not len(nodes):
                continue
            begin, long = trie.label_at[nodes], trie.label_end[nodes] - trie.label_at[nodes]
            total = np.concatenate([[0], np.cumsum(long)])
            if total[-1] > lot and len(nodes) > 1:
                cut = max(1, int(np.searchsorted(total, lot, "right")) - 1)
                waiting.append((nodes[cut:], had[cut:]))
                nodes, had, begin, long, total = nodes[:cut], had[:cut], begin[:cut], long[:cut], total[: cut + 1]
            if not marked:
                mark[own] = marked = True
            place = np.arange(total[-1]) + np.repeat(begin - total[:-1], long)
            hits = np.concatenate([[0], np.cumsum(mark[trie.flat[place]])])
            had = had + hits[total[1:]] - hits[total[:-1]]
            ends = trie.ends[nodes]
            near = np.flatnonzero((ends >= 0) & (ends < x) & (small + block.small[np.maximum(ends, 0)] <= block.limit(had)))
            for y, overlap in zip(ends[near].tolist(), had[near].tolist(), strict=True):
                block.link(x, y, overlap)
            # what this bundle has left beyond the path's last key, and what the longest path below has left
            last = trie.flat[np.maximum(trie.label_end[nodes] - 1, 0)]
            left = np.minimum(len(own) - np.searchsorted(own, last, "right"), trie.most[nodes] - trie.depth[nodes])
            go = (trie.child_at[nodes + 1] > trie.child_at[nodes]) & (small + block.least[nodes] <= block.limit(had + left))
            if go.any():
                first, after = trie.child_at[nodes[go]], trie.child_at[nodes[go] + 1]
                count = after - first
                below = trie.children[np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)]
                waiting.append((below, np.repeat(had[go], count)))
        if marked:
            mark[own] = False
    return block.links


def _by_block(blocks: DataFrame, work, schema: pa.Schema, text: str) -> DataFrame:
    """``work(classes, sizes, keys)`` for each block of rows (rep, i, j, cls, n, keys) that are sorted by block."""

    def run(batches):
        current, classes, sizes, keys = None, [], [], []
        for batch in batches:
            for rep, i, j, cls, n, raw in zip(*[batch.column(c).to_pylist() for c in ("rep", "i", "j", "cls", "n", "keys")], strict=True):
                if (rep, i, j) != current:
                    if len(classes) > 1:
                        yield work(current[0], classes, sizes, keys)
                    current, classes, sizes, keys = (rep, i, j), [], [], []
                classes.append(cls)
                sizes.append(n)
                keys.append(raw)
        if len(classes) > 1:
            yield work(current[0], classes, sizes, keys)

    return blocks.mapInArrow(run, text)


def _with_partners(blocks: DataFrame, percent: int) -> DataFrame:
    """(rep, cls) of the members that may have a similar one in their block, by their signatures."""
    schema = pa.schema([("rep", pa.int64()), ("cls", pa.int64())])

    def work(rep, classes, sizes, keys):
        stay = partners(np.array(sizes), [np.frombuffer(k, np.uint8) for k in keys], percent)
        own = np.array(classes, np.int64)[stay]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rep, np.int64)), pa.array(own)], schema=schema)

    return _by_block(blocks, work, schema, "rep bigint, cls bigint")


def _joined_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of classes within blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(rep, classes, sizes, keys):
        found = block_links([np.frombuffer(k, np.uint64) for k in keys], percent)
        return pa.RecordBatch.from_arrays([pa.array([classes[a] for a, _ in found], pa.int64()), pa.array([classes[b] for _, b in found], pa.int64())], schema=schema)

    return _by_block(blocks, work, schema, "a bigint, b bigint")


def _blocks(members: DataFrame, sets: DataFrame, weight: str, full: int, sized: DataFrame | None = None) -> DataFrame:
    """(rep, i, j, cls, n, keys), sorted by block; a block over ``full`` in weight is cut into parts that meet pair by pair.

    ``weight``: an expression of a set's size n. ``sized``: (cls, n), where that is cheaper to read than ``sets``, which
    are then read once.
    """
    sized = sets.select("cls", "n") if sized is None else sized
    load = look_up(members, sized, "cls", "rep").withColumn("_load", F.expr(weight))
    cuts = load.groupBy("rep").agg((F.floor(F.sum("_load") / full) + 1).cast("int").alias("parts"), F.sum("_load").alias("load"))
    cuts = durable(cuts)
    placed = look_up(members, cuts.select("rep", "parts"), "rep", "cls").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("own"))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    keyed = placed.withColumn("pair", F.explode(F.when(F.col("parts") == 1, alone).otherwise(pairs))).select("rep", "pair.i", "pair.j", "cls")
    total = cuts.agg(F.sum(F.col("load") * F.greatest(F.lit(1), F.col("parts") - 1))).first()[0] or 0
    joined = keyed.join(sets, "cls").select("rep", "i", "j", "cls", "n", "keys")
    return joined.repartition(max(12, -(-int(total) // (2 * full))), "rep", "i", "j").sortWithinPartitions("rep", "i", "j")


def class_links(docs: DataFrame, sketch: np.ndarray, postings: int, percent: int = PERCENT, part_keys: int = PART_KEYS, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links between classes that span the components of the similarity graph."""
    sc = docs.sparkSession.sparkContext
    levels = sc.broadcast(count_levels(sketch))
    buckets = max(64, -(-postings // BUCKET_POSTINGS))
    members = durable(_members(durable(_shared_keys(_postings(docs, levels, buckets, percent, heavy)))))
    marks = durable(_live_sets(docs, levels, sc.broadcast(_live_bits(members)), whole=False))
    likely = durable(_with_partners(_blocks(members, marks, f"greatest(n / 8, {part_keys / PART_SETS})", part_keys), percent).distinct())
    sets = _live_sets(docs, levels, sc.broadcast(_live_bits(likely)), whole=True)
    sizes = marks.select("cls", "n")
    return _joined_blocks(_blocks(likely, sets, f"greatest(n, {part_keys / PART_SETS})", part_keys, sizes), percent).distinct()


def _rooted(docs: DataFrame, percent: int, part_keys: int, heavy: int) -> DataFrame:
    """(doc_id, row, n, cls, root): every row with its class and the root class of its component; null for empty sets."""
    counted = durable(_counted(docs))
    rows = counted.where("block IS NULL").select("doc_id", "row", "n", "cls")
    sketch = _summed(counted.where("block IS NOT NULL").select("block", "counts"), np.uint32, _saturating)
    classes = durable(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.max("n").alias("n")))
    postings = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    if postings:
        roots = durable(components(class_links(docs, sketch, int(postings), percent, part_keys, heavy)))
    else:
        roots = docs.sparkSession.createDataFrame([], "node bigint, root bigint")
    placed = durable(classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root")))
    empty = rows.where("cls IS NULL").withColumn("root", F.lit(None).cast("bigint"))
    return look_up(rows.where("cls IS NOT NULL"), placed, "cls", "row").select(*empty.columns).unionByName(empty)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, part_keys: int = PART_KEYS, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for every row of ``docs``.

    ``component_id``: the smallest doc_id that links reach, its own included. Texts without words have an empty set and
    stand alone, null texts too. Rows that repeat are in one class. Null doc_ids are no one's smallest, unless all are.
    """
    found = durable(_rooted(docs, percent, part_keys, heavy))
    smallest = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = look_up(found.where("root IS NOT NULL"), smallest, "root", "row")
    empty = found.where("root IS NULL").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(empty, allowMissingColumns=True).select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class"), "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, part_keys: int = PART_KEYS, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per component stays: the one with the smallest doc_id.

    A null doc_id stays only where its component has no other; rows tied on doc_id are told apart by their texts, and
    of rows that repeat as a whole one stays. Texts without words are in no component and stay.
    """
    found = durable(_rooted(docs, percent, part_keys, heavy))
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stay = first.select(F.col("first")["row"].alias("_row")).unionByName(found.where("root IS NULL").select(F.col("row").alias("_row"))).distinct()
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in docs.columns], row_key(docs).alias("_row"))
    rows = rows.join(stay, "_row", "left_semi").dropDuplicates(["_row"])
    return rows.select(*[F.col(f"`_in_{c}`").alias(c) for c in docs.columns])
