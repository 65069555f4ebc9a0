"""Byte-level text kernels over Arrow columns.

A column of texts is one byte buffer with offsets. Words, lines and hashes of spans come from
whole-buffer numpy operations, so that no Python loop runs over words or documents.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SUB_BATCH_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Span hashes are two polynomials modulo this prime, at bases drawn at random.
_PRIME = (1 << 31) - 1
_BASES = (1_729_514_803, 968_302_151)
_RESIDUES = [np.maximum(mix(_TABLE + _U(k)) % _U(_PRIME), _U(1)) for k in (1, 2)]
_residue_powers = [np.ones(1, np.uint32) for _ in range(4)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        m = max(n + 1, SUB_BATCH_BYTES * 5 // 4)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _residue_power(n: int) -> list[np.ndarray]:
    """Powers of both bases, then of their inverses."""
    if len(_residue_powers[0]) <= n:
        m = max(n + 1, SUB_BATCH_BYTES * 5 // 4)
        for k, base in enumerate((*_BASES, *(pow(b, -1, _PRIME) for b in _BASES))):
            x = np.ones(1, np.uint64)
            while len(x) < m:
                x = np.concatenate([x, x * _U(pow(base, len(x), _PRIME)) % _U(_PRIME)])
            _residue_powers[k] = x[:m].astype(np.uint32)
    return _residue_powers


def _fold(x: np.ndarray) -> np.ndarray:
    """The same residue, smaller: a Mersenne prime needs no division."""
    high = x >> _U(31)
    x &= _U(_PRIME)
    x += high
    return x


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system, as a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sub_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` text bytes, or of one row."""
    for batch in batches:
        _, offsets = text_parts(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes within each text; bounds[d]:bounds[d+1] are those of text d."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = inside[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words ``[^\\x20\\x09-\\x0D]+``."""
    return spans(~_SPACE[buf], offsets)


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Cumulated polynomials of the bytes, for :func:`span_hashes`."""
    power = _residue_power(len(buf))
    out = np.empty((2, len(buf) + 1), np.uint64)
    out[:, 0] = 0
    for k in range(2):
        x = _RESIDUES[k][buf]
        x *= power[k][: len(buf)]
        np.cumsum(_fold(x), out=out[k, 1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that depend on content and length alone.

    Two spans of n bytes share one by chance of about 2**-62; no texts are built to collide, as some are for
    polynomials modulo a power of two, the Thue-Morse word and its complement for one.
    """
    power, out = _residue_power(prefix.shape[1]), []
    for k in range(2):
        x = _fold(prefix[k][ends] - prefix[k][starts])
        x *= power[2 + k][starts]
        x = _fold(_fold(x))
        out.append(np.where(x >= _U(_PRIME), x - _U(_PRIME), x))
    return mix(((out[0] << _U(31)) | out[1]) + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def rolling_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each place, quick ones modulo 2**64: unequal bytes may share one."""
    power, inverse = _power(len(buf))
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * power[: len(buf)], out=prefix[1:])
    return mix((prefix[n:] - prefix[:-n]) * inverse[: len(prefix) - n])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive word hashes; entry i covers words i to i + n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + hashes[j : j + m]
    return mix(out)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each range of offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def tune(spark) -> None:
    """Bound the Arrow batches by rows, so that long texts don't fill a worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
