"""Words, hashes of words and of word n-grams for whole Arrow batches of texts, in numpy.

A batch is hashed over its UTF-8 bytes at once: the hash of a word is a polynomial over its bytes modulo 2**64,
had from one running sum per segment, so no word becomes a Python object. Segments bound the memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
SEGMENT = 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)

#: True for the bytes of words of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: A-Z to a-z, other bytes as they are.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """The words of a batch: byte spans `starts`, `ends`, and `first`: words first[i] to first[i + 1] are those of text i."""

    def __init__(self, column: pa.Array, lower: bool = False, word_bytes: np.ndarray = NOT_SPACE):
        self.buf, self.offs = utf8(column)
        if lower:
            self.buf = ASCII_LOWER[self.buf]
        is_word = word_bytes[self.buf]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        at = self.offs[:-1][self.offs[:-1] < len(self.buf)]
        begins[at] = is_word[at]
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:]
        last = self.offs[1:][self.offs[1:] > 0] - 1
        ends[last] = is_word[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offs)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        n = len(self.starts)
        out = np.empty(n, np.uint64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SEGMENT, "right")))
            lo, hi = self.starts[i], self.ends[j - 1]
            up, down = _powers(int(hi - lo) + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.buf[lo:hi].astype(np.uint64) + U(1)) * up[: hi - lo], out=total[1:])
            a, b = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * U(0xD6E8FEB86659FD93))
            i = j
        return out


_cache: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_cache[0]) < n:
        size = max(n, SEGMENT + 1)
        for k, p in enumerate((_P, _P_INVERSE)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _cache[k] = np.cumprod(x)
    return _cache


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (runs across texts included; the caller leaves those out)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, (seed * 0x2545F4914F6CDD1D + n) & (2**64 - 1), np.uint64)
    for j in range(n):
        out *= U(0xD1342543DE82EF95)
        out += words[j : j + m]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    if len(x) < w:
        return np.zeros(0, x.dtype)
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def give_back() -> None:
    """Return free memory to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function over batches that gives its free memory back at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_press, _unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Integers as zstd over byte planes; rising values as their steps."""
    if rising and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return _press.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(data: bytes, dtype: type, rising: bool = False) -> np.ndarray:
    """The array that pack() took."""
    raw, size = np.frombuffer(_unpress.decompress(data), np.uint8), np.dtype(dtype).itemsize
    out = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).reshape(-1)
    return np.cumsum(out, dtype=dtype) if rising else out


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice has at most `limit` bytes of text (or one text): memory follows the slice."""
    for batch in batches:
        _, offs = utf8(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def runs_by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by `key`, the rows of one key at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
