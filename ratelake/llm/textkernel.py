"""Vectorised word splitting and hashing over Arrow string arrays.

A chunk of texts is one byte array. Word bounds come from a byte table, word hashes from prefix sums of a
polynomial modulo 2**64 (so a hash of any span costs one subtraction and one product), finished by a bit mixer.
All arrays are as long as a chunk (a quarter of a megabyte, or one longer text), which bounds memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Just below a power of two, as tables of powers are doubled to hold one more.
CHUNK = (1 << 18) - 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


#: What a worker process remembers between tasks, to be cleared when it starts on something else.
CACHES: list[dict] = []


def release(keep: dict | None = None) -> None:
    """Gives free memory, and that of other operators' caches in this process, back to the machine.

    A worker process serves one operator after the other; what numpy, Arrow and the caches of the one before hold
    would add to what this one needs.
    """
    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its free memory
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


class _Powers:
    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base**i and its inverse for i up to n."""
        while len(self.up) <= n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                have = getattr(self, name)
                setattr(self, name, np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))]))
        return self.up, self.down


POWERS = _Powers(_BASE)
WORD_POWERS = _Powers(0xC2B2AE3D27D4EB4F | 1)


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hashes of spans from prefix sums; equal content gives equal hashes wherever it stands."""
    return mix((prefix[end] - prefix[start]) * powers.get(len(prefix))[1][start] + (end - start).astype(np.uint64))


@dataclass
class Chunk:
    """Texts ``lo`` to ``hi`` of an array, as bytes with offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def prefix(self, flip: int = 0, powers: _Powers = POWERS) -> np.ndarray:
        n = len(self.data)
        out = np.zeros(n + 1, np.uint64)
        terms = _BYTES[self.data ^ np.uint8(flip) if flip else self.data]
        terms *= powers.get(n)[0][:n]
        np.cumsum(terms, out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and for each text the index of its first word (one more entry at the end)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.offsets), np.int64)
        space = _SPACE[self.data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[inner] = True
        after[inner - 1] = True
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(~space & after) + 1
        return start, end, np.searchsorted(start, self.offsets)


def chunks(array: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Cuts an array of strings (null: empty) into chunks of about ``limit`` bytes, whole texts each."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, where, held = array.buffers()
    offsets = np.frombuffer(where, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums ``values`` (one per word, say) by text; ``first`` has the index of each text's first value."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
