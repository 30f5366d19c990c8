"""Arrow text columns as flat numpy arrays, and vectorised word and n-gram hashes over them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it, whatever signs are in it."""
    return "`" + name.replace("`", "``") + "`"


def others(columns: list[str], new: tuple[str, ...]) -> list[str]:
    """The columns other than the new ones; names that differ in case only are one, as they are to Spark."""
    lower = {n.lower() for n in new}
    return [c for c in columns if c.lower() not in lower]


def numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as c0, c1, …, so that no name can be in the way."""
    return df.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(names)])


def named(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Numbered columns under their names again, and more columns behind them."""
    return df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *more)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def cuts(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of successive rows whose texts have about ``size`` bytes, one row at least: what is worked on at a time."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(upto):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield at, to - at
        at = to


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text): the runs of bytes other than ASCII white space, as byte positions."""
    ink = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[1:] = ink[:-1]
    before[:1] = False
    after = np.empty(len(data), bool)
    after[:-1] = ink[1:]
    after[-1:] = False
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words wherever they stand."""
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    gap = np.empty(len(starts), np.int64)
    gap[0] = starts[0]
    gap[1:] = starts[1:] - ends[:-1]
    total = int(lengths.sum())
    base = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(base, lengths)
    values = _BYTES[data[np.repeat(starts, lengths) + place]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, base) + lengths.astype(_U))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of hashes[i : i + n] for each i; shorter by n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.zeros(m, _U)
    for k, c in enumerate(mix(np.arange(11, 11 + n, dtype=_U)) | _U(1)):
        out += hashes[k : k + m] * c
    return mix(out)


def long_gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """As gram_hashes (with other values), at a cost that doesn't depend on n."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    up = powers(len(hashes))
    down = powers(m, _U(pow(int(_BASE), -1, 2**64)))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * up, dtype=_U)])
    return mix((total[n:] - total[:-n]) * down)


def characters(data: np.ndarray) -> np.ndarray:
    """Characters before each byte position of UTF-8 data, and at its end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's longs."""
    return x.view(np.int64)
