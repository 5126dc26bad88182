"""Exact duplicates by two passes over a Bloom filter of text hashes (DataFrame functions only).

Pass one sets ``HASHES`` cells of a fixed filter for each text's digest and keeps the cells that two or more rows hit:
a text that repeats has only such cells. They are packed into bitmaps of the built-in bitmap functions. Pass two tests
each row's cells: a row with a cell hit once has no equal and goes straight through, without a shuffle. Only the rest
is grouped by digest, exactly, so a false positive costs a narrow row in a shuffle and never changes a result.

The filter has ``bits`` cells, whatever the input: its bitmaps are the one thing sent to all executors, and ``bits / 8``
bytes bound them. With more than a tenth as many rows as bits most rows become candidates; choose more bits then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, durable

BITS = 1 << 26
HASHES = 2
SALTS = 256
_BITMAP_BITS = 4096 * 8  # of one bitmap of the built-in functions


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text after lower-casing A-Z; null counts as empty."""
    return F.sha2(ascii_lower(text), 256)


def _cells(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(bits)) for k in range(HASHES)]


def repeated_cells(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Bitmaps (``bucket``, ``bitmap``) of the cells that at least two rows hit. Null keys hit none."""
    cells = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_cells(key, bits))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    placed = twice.select(F.expr("bitmap_bucket_number(cell + 1)").alias("bucket"), F.expr("bitmap_bit_position(cell + 1)").alias("at"))
    return placed.groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)").alias("bitmap"))


def maybe_repeated(rows: DataFrame, key: str, filters: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` with a boolean ``_maybe``: false where the key surely occurs once."""
    found = F.lit(True)
    for k, cell in enumerate(_cells(key, bits)):
        bucket, bitmap, at = f"_bucket{k}", f"_bitmap{k}", F.pmod(cell, F.lit(_BITMAP_BITS)).cast("int")
        side = filters.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
        # at most bits / 8 bytes in all
        rows = rows.withColumn(f"_b{k}", (cell / _BITMAP_BITS).cast("bigint") + 1).join(F.broadcast(side), F.col(f"_b{k}") == F.col(bucket), "left")
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.coalesce(byte, F.lit(0)).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at % 8 + 1)) != 0)
    return rows.withColumn("_maybe", found).drop(*[f"_{c}{k}" for k in range(HASHES) for c in ("b", "bucket", "bitmap")])


def groups(keys: DataFrame, key: str = "text_sha256", bits: int = BITS) -> DataFrame:
    """(doc_id, key, keep_id, group_size): each row with the largest doc_id of its key and the number of rows.

    ``keys`` is read several times, so it should be a written table. A null doc_id is below every other; where all are
    null so is keep_id. Repeated rows count as often as they occur.
    """
    tested = maybe_repeated(keys, key, durable(repeated_cells(keys, key, bits)), bits)
    alone = tested.where(~F.col("_maybe")).select("doc_id", key, F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    rest = tested.where("_maybe").select("doc_id", key, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("_salt"))
    # a group is summed up part by part, and its rows look their part up: no task gets more than a part of a group
    parts = rest.groupBy(key, "_salt").agg(F.max("doc_id").alias("_max"), F.count("*").alias("_n"))
    sizes = parts.groupBy(key).agg(F.max("_max").alias("keep_id"), F.sum("_n").alias("group_size"))
    told = parts.select(key, "_salt").join(sizes, key)
    return alone.unionByName(rest.join(told, [key, "_salt"]).select("doc_id", key, "keep_id", "group_size"))


def mark_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one; the largest doc_id stays. Rows
    that repeat with the same doc_id and an equal text are all marked as kept.
    """
    keys = durable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("text_sha256")))
    made = groups(keys, "text_sha256", bits)
    return made.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the largest doc_id, and one of rows that tie on it.

    Rows whose text cannot repeat pass straight through; the others are narrowed to ids, grouped, and only they join.
    """
    key = "_text_sha256"
    # the rows' own columns travel under names that nothing here uses
    columns = [f"_in_{i}" for i in range(len(docs.columns))]
    hashed = docs.select(*[F.col(f"`{c}`").alias(inner) for c, inner in zip(docs.columns, columns, strict=True)], "doc_id", digest(F.col("text")).alias(key))
    keys = durable(hashed.select("doc_id", key))
    filters = durable(repeated_cells(keys, key, bits))
    tested = maybe_repeated(hashed, key, filters, bits)
    straight = tested.where(~F.col("_maybe")).select(*columns)
    likely = maybe_repeated(keys, key, filters, bits).where("_maybe")
    stays = likely.groupBy(F.col(key).alias("_key")).agg(F.max("doc_id").alias("_keep"))
    # joined by the row that stays, not by the text alone, so that no group of copies meets in one task
    rest = tested.where("_maybe").join(stays, (F.col(key) == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_keep")))
    kept = straight.unionByName(rest.dropDuplicates(["_key", "_keep"]).select(*columns))
    return kept.toDF(*docs.columns)
