"""Vectorised text primitives shared by the Python-side operators.

Everything works on Arrow string columns in chunks of about ``CHUNK_BYTES`` so that the
memory of a worker does not depend on the number of rows in an Arrow batch.  Hashes are
polynomials over Z/2^64 of randomised byte values, finished by a 64-bit mixer; they are
functions of the bytes alone, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_U = np.uint64
_POWER = 0x9E3779B97F4A7C15 | 3  # = 3 mod 4: P-1 has a single factor of two


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (the splitmix64 constants)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values(seed: int) -> np.ndarray:
    return mix64((np.arange(256, dtype=_U) + _U(1)) * _U(0xD1342543DE82EF95) + _U(seed))


def powers(n: int, base: int = _POWER) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base & (2**64 - 1), dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_inverse = pow(_POWER, -1, 2**64)
_tables: dict[str, np.ndarray] = {}


def _power_table(kind: str, n: int) -> np.ndarray:
    """At least ``n`` powers; the tables kept suit a chunk, one for a longer text lives as long as its use."""
    have = _tables.get(kind)
    if have is None or len(have) < n:
        have = powers(max(n, 2 * CHUNK_BYTES), _POWER if kind == "up" else _inverse)
        if n <= 2 * CHUNK_BYTES:
            _tables[kind] = have
    return have


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WORD_SPACE)] = True


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each span; ``values`` holds randomised uint64 symbols."""
    n = len(values)
    acc = np.empty(n + 1, dtype=_U)
    acc[0] = 0
    np.cumsum(values * _power_table("up", n)[:n], out=acc[1:])
    h = (acc[ends] - acc[starts]) * _power_table("down", n + 1)[starts]
    return mix64(h + (ends - starts).astype(_U))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive slices of a string column; null is empty.

    A slice has ``limit`` bytes at most, unless a single text is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` and the word range of each row.

    Returns (starts, ends, bounds): row i owns words bounds[i] to bounds[i + 1].
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~_IS_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begin[inner] = word[inner]
    finish = word.copy()
    finish[:-1] &= ~word[1:]
    before = inner[inner > 0] - 1
    finish[before] = word[before]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


_WORD_VALUES = _byte_values(0x5EED)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    return span_hashes(_WORD_VALUES[_LOWER[data]], starts, ends)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles, and the row of each.

    A row with 1 to width-1 words has its whole sequence as the one shingle; a row without
    words has none.
    """
    counts = np.diff(bounds)
    n = len(words)
    salt = powers(width, 0xC2B2AE3D27D4EB4F | 3)
    rows = np.repeat(np.arange(len(counts)), counts)
    if n >= width:
        rolled = np.zeros(n - width + 1, dtype=_U)
        for j in range(width):
            rolled += words[j : n - width + 1 + j] * salt[j]
        left = bounds[1:][rows[: n - width + 1]] - np.arange(n - width + 1)
        keep = left >= width
        out, owner = mix64(rolled[keep] + _U(width)), rows[: n - width + 1][keep]
    else:
        out, owner = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), dtype=_U)
        for j in range(width - 1):
            has = counts[short] > j
            extra[has] += words[bounds[short[has]] + j] * salt[j]
        out = np.concatenate([out, mix64(extra + counts[short].astype(_U))])
        owner = np.concatenate([owner, short])
    return out, owner


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs ordered by row, then hash."""
    if not len(hashes):
        return hashes, rows
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[first], r[first]


def per_row_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each row; an empty range is 0."""
    acc = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return acc[bounds[1:]] - acc[bounds[:-1]]


def exact_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word as it is written."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    return span_hashes(_WORD_VALUES[data], starts, ends)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words, a space after each, and where each begins (and the last ends)."""
    lengths = ends - starts + 1
    at = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths)])
    out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    within = np.ones(len(out), dtype=bool)
    within[at[1:] - 1] = False
    out[within] = data[np.repeat(starts - at[:-1], lengths - 1) + np.flatnonzero(within)] if len(starts) else out[within]
    return out, at
