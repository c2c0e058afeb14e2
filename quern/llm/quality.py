"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad. A line's potentials come from its own features and those of
the lines before and after it; a transition matrix ties neighbours. Forward-backward
gives each line's chance of being good; their mean, weighted by length, is calibrated to
the chance that the document is labelled good.

In training every line carries its document's label, so neighbours always agree there;
transitions are therefore bounded (``MOVE``), and lines are told by their own and their
neighbours' features first.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import words
from quern.plans.shared import small_batches

#: The classifier is fitted on at most so many labelled documents, those with the least
#: hash of their id, as long as they have at most so many lines together. In training a
#: chain is cut after so many lines. Scoring reads every document whole.
TRAIN_DOCS, TRAIN_LINES, CHAIN = 4_000, 1_000_000, 512
STEPS, RATE, DECAY = 150, 0.08, 1e-4
KEEP = 0.3
#: The bound on transitions between neighbours' labels.
MOVE = 1.0
_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[words.SPACE] = 3
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 4
_KIND[ord("|")] = 5
_KIND[ord("!")] = 6
_KIND[[ord(c) for c in "#$%&*@+=<>~^_/\\[]{}`"]] = 7
OWN = 11
WIDTH = OWN + 2 * (OWN - 1) + 2


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, bytes and text (by number) of every line; an empty text is one empty line."""
    n_docs = len(offs) - 1
    cut = np.flatnonzero(data == 10)
    begin = np.concatenate([offs[:-1], cut + 1])
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(offs, cut, "right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.where(last, offs[doc + 1], np.append(begin[1:] - 1, 0))
    n = len(begin)
    # empty texts begin where the next text does: a byte belongs to the last line that begins at it
    line = np.searchsorted(begin, np.arange(len(data)), "right") - 1
    count = np.bincount(line * 8 + _KIND[data], minlength=8 * n).reshape(n, 8).astype(float)
    size = (end - begin).astype(float)
    starts, ends, _ = words.words(data, offs)
    of = line[starts] if len(starts) else starts
    n_words = np.bincount(of, minlength=n).astype(float)
    h = words.hashes(data, starts, ends)
    again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[1:][again], minlength=n).astype(float) if len(h) > 1 else np.zeros(n)
    w, letters = n_words + 1, count[:, 0] + count[:, 1]
    own = np.stack(
        [np.ones(n), count[:, 1] / (letters + 1), count[:, 7] / w, count[:, 5] / w, count[:, 6] / w, 10 * count[:, 2] / (size + 1), count[:, 4] / w, np.log1p(n_words) / 4, repeats / w, letters / w / 10, (size == 0).astype(float)],
        axis=1,
    )
    own = np.minimum(own, 3.0)
    first = np.append(True, doc[1:] != doc[:-1]) if n else np.zeros(0, bool)
    before = np.where(first[:, None], 0, np.roll(own[:, 1:], 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own[:, 1:], -1, axis=0))
    return np.concatenate([own, before, after, first[:, None], last[:, None]], axis=1), size, doc


class _Chains:
    """Texts' lines laid out by place: step t holds line t of every text that long, longest texts first."""

    def __init__(self, doc: np.ndarray):
        counts = np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
        begin = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        longest = int(counts.max()) if len(counts) else 0
        active = np.searchsorted(-counts[order], -np.arange(longest), "left")
        self.steps = [begin[order[:k]] + t for t, k in enumerate(active)]

    def marginals(self, score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's log chances, and the summed chances of each pair of neighbours' labels."""
        fwd, bwd = score.copy(), np.zeros_like(score)
        for a, b in zip(self.steps, self.steps[1:], strict=False):
            x = fwd[a[: len(b)]]
            fwd[b] += np.stack([np.logaddexp(x[:, 0] + move[0, j], x[:, 1] + move[1, j]) for j in (0, 1)], axis=1)
        pairs = np.zeros((2, 2))
        for a, b in zip(self.steps[-2::-1], self.steps[:0:-1], strict=False):
            a = a[: len(b)]
            x = score[b] + bwd[b]
            bwd[a] = np.stack([np.logaddexp(move[i, 0] + x[:, 0], move[i, 1] + x[:, 1]) for i in (0, 1)], axis=1)
            joint = fwd[a][:, :, None] + move[None] + x[:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(len(a), 4), axis=1)[:, None, None]
            pairs += np.exp(joint).sum(axis=0)
        log = fwd + bwd
        return log - np.logaddexp(log[:, 0], log[:, 1])[:, None], pairs


@dataclasses.dataclass
class Model:
    weights: np.ndarray  # of features, for a good line against a bad one
    move: np.ndarray  # between labels of neighbours
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Each line's chance of being good."""
        score = np.stack([np.zeros(len(x)), x @ self.weights], axis=1)
        return np.exp(_Chains(doc).marginals(score, self.move)[0][:, 1])

    def documents(self, x: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Each text's score: its lines' chances, weighted by length, calibrated."""
        w = size + 1
        mean = np.bincount(doc, w * self.lines(x, doc)) / np.bincount(doc, w)
        return 1 / (1 + np.exp(-(self.slope * _logit(mean) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, 0.0, 0.0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-9)


def fit_lines(x: np.ndarray, size: np.ndarray, doc: np.ndarray, good: np.ndarray, steps: int = STEPS) -> Model:
    """Fit to texts whose lines carry their text's label; texts of either label weigh alike in sum."""
    y = good[doc].astype(int)
    place = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    first = place % CHAIN == 0
    chains = _Chains(np.cumsum(first) - 1)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    model, adam, n = Model(np.zeros(x.shape[1]), np.zeros((2, 2))), _Adam(RATE), max(1, len(x))
    for _ in range(steps):
        score = np.stack([np.zeros(len(x)), x @ model.weights], axis=1)
        log, expected = chains.marginals(score, model.move)
        g = np.concatenate([(x.T @ (y - np.exp(log[:, 1]))) / n - DECAY * model.weights, ((pairs - expected) / n - DECAY * model.move).ravel()])
        step = adam.step(g)
        model.weights = model.weights + step[: x.shape[1]]
        # neighbours' labels always agree in training; a bound keeps one line from settling a text
        model.move = np.clip(model.move + step[x.shape[1] :].reshape(2, 2), -MOVE, MOVE)
    w = size + 1
    z = _logit(np.bincount(doc, w * model.lines(x, doc)) / np.bincount(doc, w))
    a = _Adam(0.05)
    ab = np.array([1.0, 0.0])
    for _ in range(400):
        p = 1 / (1 + np.exp(-(ab[0] * z + ab[1])))
        ab = ab + a.step(np.array([((good - p) * z).mean(), (good - p).mean()]) - 1e-3 * np.array([ab[0] - 1, ab[1]]))
    model.slope, model.shift = max(0.05, float(ab[0])), float(ab[1])
    return model


def fit(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` rows of ``labels(doc_id, quality)``, joined to ``documents(doc_id, text)``.

    The documents have at most ``TRAIN_LINES`` lines together.

    Rows with a null id or quality are no labels. Line features are made on the
    executors; the driver gets numbers of the sample only. Without rows, or with one
    label only, every score is that label's share with a prior of a half.
    """
    small_batches(documents.sparkSession)
    few = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quality = b.column("quality").to_numpy()
            for at, _, data, offs in words.slices(b.column("text")):
                x, size, doc = line_features(data, offs)
                edge = np.flatnonzero(np.diff(doc, prepend=-1))
                for i, (lo, hi) in enumerate(zip(edge, [*edge[1:], len(doc)], strict=True)):
                    yield pa.record_batch([pa.array([int(quality[at + i])], pa.int32()), pa.array([x[lo:hi].astype("<f4").tobytes()]), pa.array([size[lo:hi].astype("<f4").tobytes()])], ["quality", "x", "size"])

    rows = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # the summary has a row a sampled document
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0))
    fits = rows.select("doc_id", F.coalesce(lines, F.lit(1)).alias("n")).withColumn("upto", upto).agg(F.max("upto").alias("all"), F.max(F.when(F.col("upto") <= TRAIN_LINES, F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"))).alias("last")).first()
    if fits["all"] is not None and fits["all"] > TRAIN_LINES:
        h, last = (fits["last"]["h"], fits["last"]["doc_id"]) if fits["last"] else (-(1 << 63), None)
        rows = rows.where((F.xxhash64("doc_id") < h) | ((F.xxhash64("doc_id") == h) & (F.col("doc_id") <= F.lit(last))))
    rows = rows.select("quality", "text")
    rows = rows.mapInArrow(run, "quality int, x binary, size binary").collect()
    rows.sort(key=lambda r: (r["quality"], bytes(r["x"])))  # a result that doesn't depend on the order of tasks
    good = np.array([r["quality"] > 0 for r in rows], float)
    if len(rows) == 0 or good.min() == good.max():
        share = (good.sum() + 0.5) / (len(rows) + 1)
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    x = [np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(a) for a in x])
    return fit_lines(np.concatenate(x).astype(float), np.concatenate([np.frombuffer(r["size"], "<f4") for r in rows]).astype(float), doc, good)


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score`` (0 to 1, higher is better) in place of any column of that name.

    Only ``text`` is read, whole. A null or empty text is one empty line. Repeated rows
    get equal scores. An empty table gives no rows.
    """
    small_batches(documents.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [model.documents(*line_features(data, offs)) for _, _, data, offs in words.slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    columns = [F.col(f"`{c.replace('`', '``')}`") for c in documents.columns if c != "score"]
    return documents.select(*columns, score("text").alias("score"))


def label_lines(documents: DataFrame, model: Model) -> DataFrame:
    """Every line of ``documents(doc_id, text)``: ``doc_id, line`` (from 0), ``n_bytes, p_good, good``."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _, data, offs in words.slices(b.column("text")):
                x, size, doc = line_features(data, offs)
                p = model.lines(x, doc)
                line = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
                yield pa.record_batch([b.column("doc_id").take(pa.array(doc + at)), pa.array(line), pa.array(size.astype("int64")), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "line", "n_bytes", "p_good", "good"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, line bigint, n_bytes bigint, p_good double, good boolean")


def held_out() -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(documents, fit(documents, labels.where(~held_out())))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
