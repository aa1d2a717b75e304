"""Vectorised word kernels over Arrow UTF-8 buffers, for use inside mapInArrow tasks.

Texts of a batch are taken in chunks of a few MB at document borders, so memory stays bounded by the chunk and by the
longest single text. A word is a maximal run of bytes outside a separator table; separators are ASCII, so this is right
for UTF-8. Word hashes are 64-bit polynomial hashes of the bytes, mixed with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_B = U(0x9E3779B97F4A7C15 | 1)
_C = U(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 20


def _separators(chars) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: words are [^\x20\x09-\x0D]+
SPACE = _separators([0x20, *range(0x09, 0x0E)])
#: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased
NON_ALNUM = _separators([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n (the longest table asked for is kept)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        t = np.full(size, U(base))
        t[0] = 1
        _powers[base] = have = np.multiply.accumulate(t)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of consecutive texts. docs[i]:docs[i+1] are text i's words; start/end are byte places in data."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, lower: bool = False):
        self.raw, self.offs = data, offs
        self.data = LOWER[data] if lower else data
        n = len(data)
        word = ~sep[self.data]
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            full = offs[1:] > offs[:-1]
            a, b = offs[:-1][full], offs[1:][full] - 1
            first[a], last[b] = word[a], word[b]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.docs = np.searchsorted(self.start, offs)
        self._hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.data)
            sums = np.zeros(n + 1, U)
            np.cumsum((self.data.astype(U) + U(1)) * powers(int(_B), n), out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * powers(_inverse(int(_B)), n)[self.start]
            self._hash = mix(h + (self.end - self.start).astype(U) * _C)
        return self._hash

    def ngrams(self, k: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """Hash of words i..i+k-1 for every i < len - k + 1, document borders ignored (see inside())."""
        h = self.hash if hashes is None else hashes
        m = max(0, len(h) - k + 1)
        if k <= 4:
            acc = np.zeros(m, U)
            for j in range(k):
                acc = acc * _B + h[j : j + m]
            return mix(acc + U(k))
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * powers(int(_C), len(h)), out=sums[1:])
        return mix((sums[k:] - sums[: len(sums) - k])[:m] * powers(_inverse(int(_C)), max(m, 1))[:m] + U(k))

    def inside(self, k: int) -> np.ndarray:
        """Which n-gram places lie in one document."""
        m = max(0, len(self.start) - k + 1)
        return np.arange(m) + k <= np.repeat(self.docs[1:], self.counts)[:m]


def sums_by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of chunks of at most `limit` bytes, or of one longer text. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
