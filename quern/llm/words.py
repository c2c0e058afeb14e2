"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, without a Python object a word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes, one text at least.
SLICE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_FOLDED = _BYTE[_UPPER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for b in (_BASE, _INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: What operators keep in this worker process between tasks, by the operator's name.
kept: dict[str, dict] = {}


def give_back(user: str = "words") -> None:
    """Return to the system what earlier batches and tasks of this worker have freed, and what other operators keep here."""
    global _powers
    for name, cache in kept.items():
        if name != user:
            cache.clear()
    if len(_powers[0]) > 2 * SLICE:
        _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and offsets (len + 1) of slices of a text column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    # a worker serves many tasks: what the last batch left goes back to the system
    give_back()
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts (by number) of all words: runs without ASCII white space, within a text."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z as a-z: a polynomial over random codes of its bytes, mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _up_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_FOLDED[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
