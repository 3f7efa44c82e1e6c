"""Flat text buffers: whole Arrow string columns as one byte array, handled by numpy without a Python object per row.

All functions here treat a column of texts as (data, offsets): ``data`` holds the UTF-8 bytes of all rows one after
another and row ``i`` is ``data[offsets[i]:offsets[i + 1]]``. Nulls count as empty texts.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a kernel handles at once, each of which takes some tens of 64-bit numbers; a longer text is handled alone and whole.
SLICE_BYTES = 1 << 19

#: The prime of the polynomial hashes, 2**31 - 1: a product of two residues fits 64 bits.
PRIME = (1 << 31) - 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class _Kept(dict):
    """What each process computes for itself: empty when it is sent to another."""

    def __reduce__(self):
        return _Kept, ()


_POWERS = _Kept()
#: Two bases, drawn anew by each driver and sent to its executors with the functions, so that no text can be made to collide.
BASES = tuple(secrets.randbelow(PRIME - (1 << 21)) + (1 << 20) for _ in range(2))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def residues(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, of 63-bit numbers."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    x = (x & prime) + (x >> bits)
    x = (x & prime) + (x >> bits)
    return x - prime * (x >= prime)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each base its powers 0 to n - 1, and their inverses."""
    have = _POWERS.get(BASES)
    if have is None or have[0].shape[1] < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones((2, size), dtype=np.uint32), np.ones((2, size), dtype=np.uint32)
        for table, bases in zip(have, (BASES, [pow(b, -1, PRIME) for b in BASES]), strict=True):
            for row, base in zip(table, bases, strict=True):
                k = 1
                while k < size:
                    row[k : 2 * k] = residues(row[:k].astype(np.uint64) * np.uint64(pow(base, k, PRIME)))
                    k *= 2
        _POWERS[BASES] = have
    return have[0][:, :n], have[1][:, :n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Two rows of prefix sums of the polynomials modulo PRIME, one more than there are bytes."""
    n = len(data)
    out = np.zeros((2, n + 1), dtype=np.uint64)
    value = data.astype(np.uint64) + np.uint64(1)
    for sums, power in zip(out, _powers(n + 1)[0], strict=True):
        terms = value * power[:n]  # 40 bits each
        np.cumsum(terms if n < 1 << 22 else residues(terms), out=sums[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] of 62 bits, equal for equal bytes wherever they stand; of n bytes that differ, equal with probability (n / 2**31)**2 at most."""
    one, two = (residues(residues(sums[end] - sums[start]) * inverse[start]) for sums, inverse in zip(prefix, _powers(prefix.shape[1])[1], strict=True))
    return mix((one << np.uint64(31) | two) + (end - start).astype(np.uint64) * _M2)


def text_bits(text):
    """60 bits of the text's SHA-256, a column that is never null; nulls are empty texts.

    As it can't be null, joins of either kind add no filter, so that they can share a shuffle.
    """
    return F.coalesce(F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column, offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, values = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, index: int, max_bytes: int = SLICE_BYTES):
    """The batch in runs of rows of at most max_bytes of text each; one longer row is a run of its own."""
    _, offsets = flat(batch.column(index))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z to a-z, others to themselves."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_table() -> np.ndarray:
    """True for bytes of words: 0-9, a-z and all bytes of characters beyond ASCII."""
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


def word_spans(lowered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of all words by byte, and where each row's words begin (one more than rows); words end with their row."""
    n = len(lowered)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word_table()[lowered]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return start, end, np.searchsorted(start, offsets)


def annotate(df: DataFrame, text: str, outputs: T.StructType, kernel, keep: list[str] | None = None, max_bytes: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns (default: all) of df with the kernel's columns added, row by row, in one narrow stage.

    ``kernel(column)`` gets an Arrow string column of at most ``max_bytes`` (or one longer text) and returns the Arrow
    arrays of ``outputs``. An input column whose name (in any case) is that of an output is replaced by it.
    """
    taken = {f.name.lower() for f in outputs.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([df.schema[c] for c in kept] + list(outputs.fields))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0, max_bytes):
                made = kernel(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=schema.names)

    return source.mapInArrow(run, schema)
