"""Helpers of the text operators: Arrow slices of bounded size, words and hashes on bytes, row-wise columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storegrain.session import ship

#: Bytes of text that one numpy step works on; a longer text makes a step of its own.
SLICE_BYTES = 1 << 19
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SHIFT = np.uint64(33)

#: Word bytes of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all (in place)."""
    with np.errstate(over="ignore"):
        for factor in (MIX_1, MIX_2):
            x ^= x >> SHIFT
            x *= factor
        x ^= x >> SHIFT
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, up to ``n``."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n + 1:
        size, base = max(n + 1, 2 * SLICE_BYTES), BASES[which]
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])
                     for b in (base, pow(base, -1, 2**64)))
        for array in have:
            np.multiply.accumulate(array, out=array)
        _POWERS[which] = have
    return have


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """``h`` with ``h[i]`` the polynomial hash of the first ``i`` bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), which)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts, ends, which: int = 0) -> np.ndarray:
    """Hashes of byte ranges, whatever their place; mixed."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), which)[1][starts])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has about ``limit`` bytes of text, but one row at least."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends, lo = np.cumsum(lengths), 0
        while lo < len(lengths):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the words in ``data``, and the rank of the first word of each text; no word spans two texts."""
    mask = is_word[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Hashes of the words (``data`` in lower case) and the rank of the first word of each text."""
    starts, ends, first = words(data, offsets, is_word)
    return span_hash(prefix_hash(data), starts, ends), first


def with_columns(df: DataFrame, text: str, added: str, work: Callable[[], Callable]) -> DataFrame:
    """Add columns that are worked out from one text column, slice by slice.

    ``work()`` is called once in each task and returns a function from an Arrow text column to a list of
    Arrow columns in the order of ``added`` (a DDL string). Columns of ``df`` with the same names are replaced.
    """
    fields = T._parse_datatype_string(added)
    kept = [c for c in df.columns if c not in fields.names]
    column = F.col(f"`{text}`")
    df = df.select(*(F.col(f"`{c}`") for c in kept), column.alias("__text")) if text not in kept else df.select(*(F.col(f"`{c}`") for c in kept))
    at, names = (kept.index(text) if text in kept else len(kept)), [*kept, *fields.names]

    def run(batches):
        step = work()
        for part in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *step(part.column(at))], names)

    ship(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, text_col: str = "text", *more) -> DataFrame:
    """``row`` (all columns but the text as a struct), ``text`` and ``more``: no column of ``docs`` can clash with working columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(True).alias("none")]
    return docs.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").alias("text"), *more)


def unpacked(rows: DataFrame, columns: list[str], text_col: str = "text", text=None, **replaced) -> DataFrame:
    """The ``columns`` of ``packed`` rows again; ``text`` and ``replaced`` take the place of columns of those names."""
    new = {text_col: F.col("text") if text is None else text, **replaced}
    return rows.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns))
