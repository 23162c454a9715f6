"""Token ids of many texts from remembered words.

A vocabulary whose tokens never reach over a cut gives a text's ids as the chain of its words' ids, so a
word is encoded once and looked up afterwards.  Words are cut and numbered in Arrow; numpy strings the ids
together.  ``CACHE`` words are remembered in two generations: when the newer one is half the bound it takes the
older one's place, so that what is met often stays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 600_000
LONG = 64                                       # longer words are seldom met again: encoded, not remembered


class Memo:
    """``encode`` (a list of keys to a list of values) with the values of short keys remembered."""

    def __init__(self, encode: Callable[[list], list], size: int = CACHE, longest: int = LONG):
        self.encode, self.half, self.longest = encode, size // 2, longest
        self.new: dict = {}
        self.old: dict = {}

    def __call__(self, keys: list) -> list:
        out = list(map(self.new.get, keys))
        missing = [k for k, v in enumerate(out) if v is None]
        if missing:
            asked = [keys[k] for k in missing]
            got = list(map(self.old.get, asked))
            fresh = [k for k, v in enumerate(got) if v is None]
            if fresh:
                for k, v in zip(fresh, self.encode([asked[k] for k in fresh]), strict=True):
                    got[k] = v
            for k, v in zip(missing, got, strict=True):
                out[k] = v
            if len(self.new) >= self.half:
                self.old, self.new = self.new, {}
            longest = self.longest
            self.new.update((k, v) for k, v in zip(asked, got, strict=True) if len(k) <= longest)
        return out


    def forget(self) -> None:
        self.new, self.old = {}, {}


def give_back() -> None:
    """Return freed memory to the system, so that an idle worker holds none (where the C library can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` for every i, in one array."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


def chain(values: list[bytes], index: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """``values[i]`` (arrays of ``dtype`` as bytes) for every i of ``index`` in one array, and each one's length."""
    flat = np.frombuffer(b"".join(values), dtype)
    size = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
    length = size[index]
    return flat[ragged((np.cumsum(size) - size)[index], length)], length


def numbered(words: pa.Array) -> tuple[list, np.ndarray]:
    """The distinct values and, for every word, its place among them."""
    d = words.dictionary_encode()
    return d.dictionary.to_pylist(), np.asarray(d.indices)


def pieces_of(col: pa.Array, max_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text (one row at least)."""
    size = np.asarray(pc.fill_null(pc.cast(pc.binary_length(col), pa.int64()), 0))
    part = np.cumsum(size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(col)]
    yield from ((s, e) for s, e in zip(cuts, cuts[1:], strict=False) if e > s)
