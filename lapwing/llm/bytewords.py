"""Words and hashes of whole Arrow columns of text, by numpy on their UTF-8 bytes.

The words of all rows of a batch are found and hashed together; no Python runs
per word.  Memory is bounded: texts are taken in chunks of about ``CHUNK``
bytes, and within a chunk the byte-wise arrays exist for a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
PIECE = 1 << 19
#: Bits that number a chunk's rows in ``keyed``; fixed, so that what is left of a hash is alike in all chunks.
ROW_BITS = 16
U = np.uint64
BYTES = np.arange(256)

#: Bytes of ``[^\x20\x09-\x0D]``.
SPACED = ~((BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D)))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
ALNUM = ((BYTES >= 0x30) & (BYTES <= 0x39)) | ((BYTES >= 0x61) & (BYTES <= 0x7A)) | (BYTES >= 0x80)
#: A-Z to a-z.
LOWER = np.where((BYTES >= 0x41) & (BYTES <= 0x5A), BYTES + 32, BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=U)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        m = max(1024, 2 * n)
        p = np.full(m, _BASE, dtype=U)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a string column in chunks: (first row, end row, bytes, row offsets in the bytes)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b), a + (1 << ROW_BITS))
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def find_words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACED, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: row in the chunk, first byte, bytes, 64-bit hash."""
    n = len(buf)
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offs[:-1]] = True
    begins, sizes, hashes = [], [], []
    a = 0
    while a < n:
        b = min(n, a + PIECE)
        while b < n and not fresh[b] and is_word[LOWER[buf[b]] if lower else buf[b]]:
            b += 1
        x = LOWER[buf[a:b]] if lower else buf[a:b]
        w = is_word[x]
        first = w.copy()
        first[1:] &= ~w[:-1] | fresh[a + 1 : b]
        at = np.flatnonzero(w)
        if len(at):
            heads = np.flatnonzero(first[at])
            size = np.diff(np.append(heads, len(at)))
            k = np.arange(len(at)) - np.repeat(heads, size)
            h = np.add.reduceat(_BYTE[x[at]] * powers(int(size.max()))[k], heads)
            begins.append(at[heads] + a)
            sizes.append(size)
            hashes.append(mix(h ^ (size.astype(U) * U(0xD6E8FEB86659FD93))))
        a = b
    if not begins:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    begin = np.concatenate(begins)
    return np.searchsorted(offs, begin, side="right") - 1, begin, np.concatenate(sizes), np.concatenate(hashes)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order: one sort, several times as fast as numpy's hash table of large arrays."""
    x = np.sort(x)
    first = np.ones(len(x), dtype=bool)
    first[1:] = x[1:] != x[:-1]
    return x[first]


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin and end in an array sorted by row."""
    return np.searchsorted(row, np.arange(rows + 1))


def windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words inside a row, and the index of the first word of each."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    s = np.zeros(n, dtype=U)
    for j in range(size):
        s = (s + h[j : j + n]) * U(0xFF51AFD7ED558CCD)
        s ^= s >> U(29)
    at = np.flatnonzero(row[:n] == row[size - 1 : size - 1 + n])
    return mix(s[at] + U(size)), at


def keyed(row: np.ndarray, h: np.ndarray, bits: int = ROW_BITS) -> np.ndarray:
    """Row and hash in one sortable word: the row in ``bits`` bits above, the hash's upper bits below.

    Hashes that are compared between chunks need the same ``bits`` in all of them.
    """
    return (row.astype(U) << U(64 - bits)) | (h >> U(bits))


def bits_of(rows: int) -> int:
    """The bits that number a chunk's rows, for hashes compared inside a row only."""
    return max(1, int(rows).bit_length())
