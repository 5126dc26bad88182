"""Language identification by n-gram filters that answer with a bitmask of languages.

Learning: character n-grams (two to four signs, within words, word edges counting as a sign) are counted by language.
A language *contains* an n-gram when it makes up at least ``MIN_SHARE`` of the language's n-grams of that length and at
least ``RATIO`` of its greatest share in any language, so that stray foreign lines teach nothing. All n-grams go into
one bit-sliced Bloom filter: each slot holds one bit per language, an n-gram sets its languages' bits in ``HASHES``
slots, and the bitwise AND of those slots returns all languages that contain it.

Deciding: for each text and language, the n-grams whose mask has its bit are counted; the number that false positives
of that bit slice would give is taken off; the language with most is chosen.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import map_slices, mix, slices, u64

#: Labelled rows of each language that the fit reads, about (a hash of doc_id picks them).
FIT_ROWS = 10_000
MIN_SHARE = 2e-5
RATIO = 0.25
SLOT_BITS = 21
HASHES = 3
SIZES = (2, 3, 4)
UNKNOWN = "und"
SLICE = 1 << 19  # bytes of text at once: a sign takes some hundred bytes of arrays
PREDICTED = "doc_id bigint, lang_pred string, score double, margin double"

_LETTERS: list[np.ndarray] = []
_K = [u64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of five. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each size: 64-bit n-grams and the row of each; and for each row whether it has a letter."""
    low = [(t or "").lower() for t in texts]
    row = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    has = np.zeros(len(low), bool)
    has[row[letter]] = True
    # signs that are no letters, and the ends of texts, are all the same edge, 0
    sign = np.zeros(len(code) + 4, np.uint64)
    sign[1 : len(code) + 1] = np.where(letter, code, 0)
    at = np.flatnonzero(letter)
    where = row[at]
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else last
    before = np.where(first[at], u64(0), sign[at])
    one = sign[at + 1]
    after = np.where(last[at], u64(0), sign[at + 2])
    then = np.where(last[at] | last[np.minimum(at + 1, len(last) - 1)], u64(0), sign[at + 3]) if len(at) else after
    made, rows = [], []
    for size in SIZES:
        if size == 2:
            keep, parts = slice(None), (one, after)
        elif size == 3:
            keep, parts = slice(None), (before, one, after)
        else:
            keep, parts = after != 0, (before, one, after, then)
        h = np.full(len(where[keep]), u64(size))
        for k, part in zip(_K, parts, strict=False):
            h = h + (part[keep] + u64(1)) * k
        made.append(mix(h))
        rows.append(where[keep])
    return made, rows, has


@dataclass
class Model:
    """Languages in order, bit planes of 64 languages each over the slots, and each language's false-positive rate."""

    languages: list[str]
    planes: list[np.ndarray]
    false_rate: np.ndarray

    def masks(self, gram: np.ndarray, plane: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that contain each n-gram."""
        low = u64((1 << SLOT_BITS) - 1)
        found = plane[(gram & low).astype(np.int64)]
        for k in range(1, HASHES):
            found = found & plane[((gram >> u64(SLOT_BITS * k)) & low).astype(np.int64)]
        return found

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected counts (text, language), numbers of n-grams, and whether a text has a letter."""
        made, rows, has = grams(texts)
        counts = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for gram, row in zip(made, rows, strict=True):
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            total += np.diff(bounds)
            for p, plane in enumerate(self.planes):
                mask = self.masks(gram, plane)
                for bit in range(min(64, len(self.languages) - 64 * p)):
                    hit = np.zeros(len(mask) + 1, np.int32)
                    np.cumsum((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), out=hit[1:])
                    counts[:, 64 * p + bit] += hit[bounds[1:]] - hit[bounds[:-1]]
        return np.clip((counts - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None), total, has

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, share of the text's n-grams that it contains, and its lead over the next as a share of its own."""
        counts, total, has = self.count(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = counts.argmax(1)  # at a tie the language with more learned text, by the order of the languages
        top = counts[np.arange(len(texts)), best]
        others = counts.copy()
        others[np.arange(len(texts)), best] = 0
        score = np.where(has, np.clip(top / np.maximum(total, 1), 0, 1), 0.0)
        margin = np.where(has, (top - others.max(1)) / np.maximum(top, 1), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], score, np.clip(margin, 0, 1)


def _count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, size, gram, n), summed within tasks."""
    out = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[tuple[str, int], list] = {}

        def merged(parts):
            gram = np.concatenate([p[0] for p in parts])
            distinct, which = np.unique(gram, return_inverse=True)
            return distinct, np.bincount(which, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for a, b, _, _ in slices(batch.column("text"), SLICE):
                langs = np.array(batch.column("lang").slice(a, b - a).to_pylist(), object)
                made, rows, _ = grams(batch.column("text").slice(a, b - a).to_pylist())
                for size, gram, row in zip(SIZES, made, rows, strict=True):
                    of = langs[row]
                    for lang in set(langs.tolist()):
                        distinct, n = np.unique(gram[of == lang], return_counts=True)
                        parts = held.setdefault((lang, size), [])
                        parts.append((distinct, n))
                        if len(parts) == 8:
                            parts[:] = [merged(parts)]
        for (lang, size), parts in held.items():
            distinct, n = merged(parts)
            for a in range(0, len(distinct), 50_000):
                piece = distinct[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(piece)), pa.array(np.full(len(piece), size, np.int32)), pa.array(piece.view(np.int64)), pa.array(n[a : a + 50_000])], schema=out)

    return labelled.select("lang", "text").mapInArrow(run, "lang string, size int, gram bigint, n bigint")


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the rows with a language that are not held out.

    The driver gets one row per language, and of each n-gram length at most 1 / MIN_SHARE n-grams per language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [], np.zeros(0))
    chance = F.lit(0.0)
    for lang, n in sizes.items():
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_rows / n))).otherwise(chance)
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < chance * 1_000_000)
    counts = _count_grams(sample).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= MIN_SHARE)
    both = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("of"))
    kept = both.select("gram", F.expr(f"transform(filter(of, x -> x.share >= {RATIO} * most), x -> x.lang)").alias("langs"))
    rows = kept.toArrow()
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    number = {lang: i for i, lang in enumerate(languages)}
    gram = rows.column("gram").to_numpy().view(np.uint64)
    langs = [[number[x] for x in r] for r in rows.column("langs").to_pylist()]
    planes, rates = [], []
    for first in range(0, len(languages), 64):
        own = languages[first : first + 64]
        kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(own) <= bits)
        plane = np.zeros(1 << SLOT_BITS, kind)
        mask = np.array([sum(1 << (x - first) for x in r if first <= x < first + 64) for r in langs], kind)
        for k in range(HASHES):
            np.bitwise_or.at(plane, ((gram >> u64(SLOT_BITS * k)) & u64((1 << SLOT_BITS) - 1)).astype(np.int64), mask)
        planes.append(plane)
        rates += [float(((plane >> kind(b)) & kind(1)).mean()) ** HASHES for b in range(len(own))]
    return Model(languages, planes, np.array(rates))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, margin) of each row's whole text, with the columns ``keep`` after them.

    ``und`` with score 0 for a null text, a text without a letter, or a model that learned no language. The score is
    the share of the text's n-grams that the language contains. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    schema = PREDICTED + "".join(f", `{c}` {types[c]}" for c in keep)

    def make():
        def work(batch, data, offsets):
            texts = batch.column("text").to_pylist()
            lang, score, margin = shared.value.decide(texts)
            return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score, "margin": margin} | {c: batch.column(c) for c in keep}

        return work

    narrow = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("text", F.col("text").cast("string"))
    return map_slices(narrow.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]), "text", schema, make, SLICE)


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language.

    A row goes when its text is null or has no letter, or when no language contains the share ``least`` of its
    n-grams. A model that learned no language judges letters only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b, _, _ in slices(batch.column("text"), SLICE):
                rows = batch.slice(a, b - a)
                texts = rows.column("text").to_pylist()
                if shared.value.languages:
                    lang, score, _ = shared.value.decide(texts)
                    keep = [x != UNKNOWN and s >= least for x, s in zip(lang, score.tolist(), strict=True)]
                else:
                    keep = [any(c.isalpha() for c in t or "") for t in texts]
                yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
