"""Vectorised text work on Arrow batches: words, hashes and packed integer arrays.

Spark cuts and shuffles the rows; inside a task these helpers look at many texts at once. Words are
the runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the UTF-8 text, with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 2 << 20

_U = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20240611))
#: A random number per byte, the same for A-Z as for a-z (``FOLDED``) or one for each byte (``EXACT``).
EXACT = _SEED.integers(1, 2**64 - 1, 256, dtype=np.uint64)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    size = max(STEP_BYTES + 1, 1 << max(0, n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def forget_powers() -> None:
    """Drop the powers held for the next batch."""
    _powers.cache_clear()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits (a bijection)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    _, down = powers(len(data) + 1)
    np.cumsum(table[data] * down[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, independent of where the span stands."""
    up, _ = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * up[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str | int, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``step_bytes`` (one row at least)."""
    _, bounds = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(bounds, bounds[at] + step_bytes, "right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each text (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where each text's words begin (one more at the end)."""
    data, bounds = utf8(column)
    starts, ends, first = words(data, bounds)
    return span_hash(prefix_hash(data, FOLDED), starts, ends), first


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: as narrow as they fit, then compressed by byte plane."""
    values = np.ascontiguousarray(values)
    if values.dtype != np.uint64:
        top = int(values.max()) if len(values) else 0
        values = values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T.tobytes() if len(values) else b""
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"u{width}").ravel()
