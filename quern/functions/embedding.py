"""Deterministic text embeddings and their similarity.

The built-in model hashes words, terms related to them and character n-grams into a
vector. Whole batches are embedded with numpy; other models plug in as providers.
"""

from __future__ import annotations

import abc
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.hashing import OFFSET, PRIME, fnv1a_bytes
from quern.plans.shared import small_batches

DIMENSION, MODEL = 128, "model-v1"
WORD_WEIGHT, GRAM_WEIGHT = 2.0, 0.25
#: Words whose places a worker keeps at most; texts, and bytes of texts, that are embedded at once.
KNOWN_WORDS, SLICE_TEXTS, SLICE_BYTES = 65_536, 512, 256 << 10
#: The built-in model's word table, for vectors equal to those it is measured against.
RELATED = {
    "transfer": ["move", "ownership", "constructor"],
    "ownership": ["move", "transfer", "constructor"],
    "move": ["transfer", "ownership", "constructor"],
    "constructor": ["transfer", "ownership", "move"],
    "raii": ["resource", "acquisition", "initialization"],
    "resource": ["raii", "acquisition", "initialization"],
    "acquisition": ["raii", "resource", "initialization"],
    "initialization": ["raii", "resource", "acquisition"],
    "virtual": ["polymorphism", "function"],
    "polymorphism": ["virtual", "function"],
    "mutex": ["mutual", "exclusion", "concurrent"],
    "mutual": ["mutex", "exclusion", "concurrent"],
    "exclusion": ["mutex", "mutual", "concurrent"],
    "concurrent": ["mutex", "mutual", "exclusion"],
}
_ENDINGS = ("ing", "es", "s", "ed")
_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def stem(word: str) -> str:
    """A word without the first of its inflections that leaves anything."""
    return next((word[: -len(e)] for e in _ENDINGS if word.endswith(e) and len(word) > len(e)), word)


class EmbeddingProvider(abc.ABC):
    """A model: its name, its dimension, and vectors for a batch of texts."""

    model_id: str
    dimension: int

    @abc.abstractmethod
    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """One row of ``dimension`` doubles a text."""


class HashingProvider(EmbeddingProvider):
    """The built-in model."""

    def __init__(self, model_id: str = MODEL, dimension: int = DIMENSION):
        if dimension <= 0:
            raise ValueError("the dimension must be positive")
        self.model_id, self.dimension, self._known = model_id, dimension, {}
        self._single: dict[tuple[int, float], tuple[tuple[int, float]]] = {}

    def _word(self, word: str) -> tuple[tuple[int, float], ...]:
        found = self._known.get(word)
        if found is None:
            places = []
            for w in (word, *RELATED.get(stem(word), ())):
                h = fnv1a_bytes(w.encode())
                places.append((h % self.dimension, WORD_WEIGHT if h >> 63 else -WORD_WEIGHT))
            # words of one place share the entry
            found = tuple(places) if len(places) > 1 else self._single.setdefault(places[0], (places[0],))
            if len(self._known) >= KNOWN_WORDS:
                self._known.clear()
            self._known[word] = found
        return found

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        n, dim = len(low), self.dimension
        out = np.zeros(n * dim)
        for i, t in enumerate(low):
            for word in _TOKEN.findall(t):
                for at, weight in self._word(word):
                    out[i * dim + at] += weight
        raw = [t.encode() for t in low]
        data = np.frombuffer(b"".join(raw), np.uint8)
        if len(data):
            starts = np.flatnonzero((data & 0xC0) != 0x80)
            edge = np.cumsum([len(r) for r in raw])
            doc = np.searchsorted(edge, starts, "right")
            ends = np.append(starts[1:], len(data))
            for k in (2, 3):
                if len(starts) < k:
                    continue
                good = doc[: len(doc) - k + 1] == doc[k - 1 :]
                a, b, of = starts[: len(starts) - k + 1][good], ends[k - 1 :][good], doc[: len(doc) - k + 1][good]
                h = np.full(len(a), OFFSET, np.uint64)
                for j in range(int((b - a).max()) if len(a) else 0):
                    inside = a + j < b
                    byte = data[np.where(inside, a + j, 0)].astype(np.uint64)
                    h = np.where(inside, (h ^ byte) * np.uint64(PRIME), h)
                sign = np.where(h >> np.uint64(63) == 1, GRAM_WEIGHT, -GRAM_WEIGHT)
                out += np.bincount(of * dim + (h % np.uint64(dim)).astype(np.int64), sign, minlength=n * dim)
        out = out.reshape(n, dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)


def slices(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Bounds of slices of at most ``SLICE_TEXTS`` texts and about ``SLICE_BYTES`` bytes; a longer text is alone."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t.isascii() else len(t.encode())
        if i > at and (i - at == SLICE_TEXTS or size + n > SLICE_BYTES):
            yield at, i
            at, size = i, 0
        size += n
    if len(texts):
        yield at, len(texts)


def _scores(provider: EmbeddingProvider, texts: pd.Series, query: np.ndarray) -> np.ndarray:
    """The cosine of each text with an embedded query."""
    plain = [t or "" for t in texts]
    return np.concatenate([np.zeros(0), *(provider.embed(plain[a:b]) @ query for a, b in slices(plain))])


def embed_column(df: DataFrame, text: str, provider: EmbeddingProvider | None = None, to: str = "vector") -> DataFrame:
    """``df`` with the vectors of a text column; a null text is embedded as empty (zeros)."""
    provider = provider or HashingProvider()
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != to]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            for at, to_ in slices(texts):
                part, x = b.slice(at, to_ - at), provider.embed(texts[at:to_])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.record_batch([*part.columns, lists], [*names, to])

    return df.select(*names).mapInArrow(run, f"{schema}, `{to}` array<double>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, both cut to the length of the shorter; 0 where a norm is 0."""
    add = lambda s, x: s + x
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), zero)), zero, add)
    square = lambda x, y: F.when(y.isNull(), zero).otherwise(F.coalesce(x.cast("double") * x.cast("double"), zero))
    norm = lambda v, w: F.sqrt(F.aggregate(F.zip_with(v, w, square), zero, add))
    return F.when((norm(a, b) == 0) | (norm(b, a) == 0), zero).otherwise(dot / (norm(a, b) * norm(b, a)))


def similarity_to(text: Column, query: str, provider: EmbeddingProvider | None = None) -> Column:
    """Cosine of a text column with a constant, which is embedded once, here.

    A condition on the column stays above it, so that the model runs once a row.
    """
    provider = provider or HashingProvider()
    q = provider.embed([query])[0]
    small_batches()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(provider, texts, q))

    return score.asNondeterministic()(text)


def register_sql(spark: SparkSession, provider: EmbeddingProvider | None = None) -> None:
    """``SIMILARITY(column, 'text')`` and ``VECTOR_SEARCH(column, 'text', threshold)`` for SQL.

    The constant is embedded once a worker.
    """
    provider = provider or HashingProvider()
    small_batches(spark)
    seen: dict[str, np.ndarray] = {}

    def scores(texts: pd.Series, queries: pd.Series) -> np.ndarray:
        out = np.zeros(len(texts))
        for q in queries.unique():
            if q not in seen:
                seen.clear()
                seen[q] = provider.embed([q or ""])[0]
            at = np.flatnonzero((queries == q).to_numpy())
            out[at] = _scores(provider, texts.iloc[at], seen[q])
        return out

    @F.pandas_udf("double")
    def similarity(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series(scores(texts, queries))

    @F.pandas_udf("boolean")
    def vector_search(texts: pd.Series, queries: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series(scores(texts, queries) >= least.astype(float).to_numpy())

    spark.udf.register("similarity", similarity)
    spark.udf.register("vector_search", vector_search)
