"""FNV-1a (64 bits) as 16 hex digits.

Each byte depends on the one before, so Spark's own higher-order functions take
microseconds a byte. Here a batch's texts advance together, a byte a step; when few are
left they are finished one by one.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.shared import small_batches

PRIME, OFFSET = 1_099_511_628_211, 14_695_981_039_346_656_037
_WRAP = (1 << 64) - 1
_FEW = 24


def fnv1a_bytes(data: bytes, h: int = OFFSET) -> int:
    """The hash of some bytes, from the state ``h``."""
    for b in data:
        h = ((h ^ b) * PRIME) & _WRAP
    return h


def fnv1a_many(rows: list[bytes]) -> np.ndarray:
    """The hashes of many byte strings."""
    sizes = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(rows), np.uint8)
    starts, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    h, prime, step = np.full(len(rows), OFFSET, np.uint64), np.uint64(PRIME), 0
    longest = int(lengths[0]) if len(rows) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left") if longest else np.zeros(0, int)
    while step < longest and active[step] > _FEW:
        k = active[step]
        h[:k] = (h[:k] ^ data[starts[:k] + step]) * prime
        step += 1
    if step < longest:
        for i in range(active[step]):
            h[i] = fnv1a_bytes(data[starts[i] + step : starts[i] + lengths[i]].tobytes(), int(h[i]))
    out = np.empty_like(h)
    out[order] = h
    return out


@functools.cache
def _udf():
    @F.pandas_udf("string")
    def fnv(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        out[there.to_numpy()] = [f"{int(x):016x}" for x in fnv1a_many([t.encode() for t in texts[there]])]
        return out

    return fnv


def fnv1a(text: Column) -> Column:
    """The hash of a text's UTF-8 bytes; null for null."""
    small_batches()
    return _udf()(text)


def content_hash(*parts: Column) -> Column:
    """The hash of one or more parts, each closed by a unit separator."""
    return fnv1a(F.concat(*[x for p in parts for x in (p, F.lit("\x1f"))]))
