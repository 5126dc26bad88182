"""What the training-data operators share: text columns, byte-level words in Arrow batches, staged tables.

Texts are read as Arrow buffers and cut into words by whole-array operations, never character by character. A batch is
worked through in slices of a few megabytes, so memory does not follow the batch; one long text is one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import durable, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 21
SPACE = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACE", "UPPER", "LOWER", "ascii_lower", "durable", "shared_dir", "slices", "map_slices", "Words", "mix", "u64", "partitions_for"]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else; null is empty. Pure ASCII takes the fast built-in, which then does the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions_for(rows: int, each: int = 250_000) -> int:
    """Partitions that hold about ``each`` narrow rows."""
    return max(1, -(-rows // each))


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * u64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * u64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_STEP = 0x5851F42D4C957F2F  # odd, one more than an even number that is not a multiple of four
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * u64(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the step and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _POWERS[:] = [np.cumprod(np.concatenate([[u64(1)], np.full(size - 1, u64(x))])) for x in (_STEP, pow(_STEP, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some texts, held as one byte array.

    ``start`` and ``end``: byte places; ``hash``: 64 bits of each word; ``first``: for text i the index of its first
    word, with the total at the end. A word never spans two texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        """``is_word``: for each byte value, whether it belongs to a word."""
        n = len(data)
        self.data, self.offsets = data, offsets
        inside = is_word[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if n else inside
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start])


def word_bytes(text: str) -> int:
    return len(text.encode())


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with at most ``most`` bytes, or of one row.

    Nulls come as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and places[-1] > places[0] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(places, places[row] + most, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop, data[places[row] : places[stop]], places[row : stop + 1] - places[row]
        row = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case (no byte of a longer character is below 128)."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def map_slices(df: DataFrame, text: str, schema: str, make: Callable[[], Callable], most: int = SLICE_BYTES) -> DataFrame:
    """Apply ``make()``, made once per task, to each slice: ``f(batch rows, bytes, offsets) -> dict of columns``.

    ``f`` may return None for "no rows".
    """
    out = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in _schema(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for row, stop, data, offsets in slices(batch.column(text), most):
                made = work(batch.slice(row, stop - row), data, offsets)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _schema(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


def _arrow(kind: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    if kind.startswith("array<") and kind[6:-1] in plain:
        return pa.list_(plain[kind[6:-1]])
    return plain[kind]


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list column: row i holds values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def char_places(data: np.ndarray, places: np.ndarray, offsets: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Byte places as code-point places within their texts."""
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    return chars[places] - chars[offsets[text_of]]


SALTS = 256


def look_up(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table`` (one row per ``key``), where some keys may hold a large part of all rows.

    The keys of ``rows`` are first reduced to (key, salt) parts, the parts look the key up, and the rows look their part
    up: a key's rows go to as many tasks as it has salts. ``spread``: the column that a row's salt is hashed from.
    Inner join; null keys find nothing. ``rows`` is read twice.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    parts = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(parts, [key, "_salt"]).drop("_salt")
