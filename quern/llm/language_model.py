"""A hashed maximum-entropy language model with a class-factored softmax.

Every word has a place in a tree of classes, sixteen to a node. The commonest words have
places of their own, the commoner the nearer the root; all others share places by their
hash. A word's chance is the product of a softmax at each node on its way, times its
share of its place by the counts. A softmax starts from the counts and is moved by hashed
weights for n-grams and skips: the word before, the one before the last, and the classes
of the two before, each together with the node. So words of one class are
told apart by context, down to their place. The score of a text is its unigram score
plus, for each node on each token's way, the gain of the model's chance over the counts'.

Counting, training and scoring each read all documents in sparse numpy batches. Training
tasks, of a bounded number of tokens each, take gradient steps on their own documents,
and what they moved is merged, block by block and a few tasks at a time, between rounds.
Counts stay in a written table: a bounded number of the commonest words is broadcast, all
others are joined. Words are told apart by 64-bit hashes throughout, so counts are exact
but for collisions of those.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import words
from quern.plans.shared import small_batches, written

#: The commonest words, at most so many, whose counts are broadcast.
HOT = 1 << 19
#: Branches of a node. By the first branch: how many branches lead to a place.
WIDTH, LEVELS = 16, 5
DEPTH = np.array([2] * 8 + [3] * 4 + [4] * 3 + [5], np.int64)
#: Places of their own by depth (the end has the first of all), the first code of each
#: depth, and places that are shared. A code has four bits a branch, to the left.
OWN, FIRST, SHARED = (8 * 16, 4 * 256, 3 * 4096), (0x00000, 0x80000, 0xC0000, 0xF0000), 1 << 16
#: Nodes of each level come after those of the levels above.
ABOVE = np.array([0, 1, 17, 273, 4369], np.int64)
NODES = 69_905
CONTEXTS = 3
#: Rows of hashed weights grow with the vocabulary, from and to these powers of two.
LEAST_ROWS, MOST_ROWS = 12, 18
ROUNDS, BATCH, RATE, TASK_TOKENS = 2, 8192, 0.3, 2_500_000
#: Blocks of weights, and tasks whose weights one step of the merge puts together.
BLOCKS, FAN = 64, 16
#: Squared gradients up to which what several tasks learned of a row adds up; beyond, it is averaged.
SURE = 8.0
END = np.uint64(0x5851F42D4C957F2D)
_END_LONG = int(END.astype(np.int64))
_GOLD, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC4CEB9FE1A85EC53)
#: Steps that are worked on at once, so that what is between stays in a core's cache.
BLOCK = 8192
_ONES = np.ones(WIDTH, "f4")


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of every token in order, an end after each text, and each text's number of tokens."""
    n = len(offs) - 1
    starts, ends, doc = words.words(data, offs)
    counts = np.bincount(doc, minlength=n) + 1
    h = np.empty(len(starts) + n, np.uint64)
    h[np.cumsum(counts) - 1] = END
    if len(starts):
        h[np.arange(len(starts)) + doc] = words.hashes(data, starts, ends)
    return h, np.repeat(np.arange(n), counts), counts


def _back(x: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """What stood ``k`` tokens before each, within its text; 0 before its start."""
    out = np.zeros(len(x), x.dtype)
    out[k:] = x[:-k] if k < len(x) else x[:0]
    out[place < k] = 0
    return out


def contexts(h: np.ndarray, code: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each token's hashed contexts: the word before, the one before the last, and the classes of the two before."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    one, two = _back(h, place, 1), _back(h, place, 2)
    near = (code >> 12).astype(np.uint64) + np.uint64(1)
    near, far = _back(near, place, 1), _back(near, place, 2)
    out = np.stack([one + np.uint64(1), two * np.uint64(5) + np.uint64(2), (near << np.uint64(9)) + far + np.uint64(3)])
    return words.mix(out)


def _room() -> np.ndarray:
    """Space for three values of a block of steps, used over and over: new memory costs more than the sums done in it."""
    return np.empty((3, BLOCK, WIDTH), "f4")


def _add_rows(to: np.ndarray, at: np.ndarray, what: np.ndarray, times: np.ndarray, last: np.ndarray, room: np.ndarray) -> None:
    """``to[at] += what * times``, also where rows repeat; ``last`` has an integer a row of ``to``.

    Most rows come once in a block. One of each is added by whole rows, which is several
    times faster than ``np.add.at``; only what else falls on a row goes that way.
    """
    row, flat = f"V{to.itemsize * WIDTH}", to.view("c8").reshape(-1)
    by_row, pairs, every = to.view(row), np.arange(WIDTH // 2), np.arange(BLOCK, dtype=last.dtype)
    for a in range(0, len(at), BLOCK):
        r = at[a : a + BLOCK]
        step = np.multiply(what[a : a + BLOCK], times[a : a + BLOCK, None], out=room[0, : len(r)])
        last[r] = every[: len(r)]
        once = last[r] == every[: len(r)]
        one, more = np.flatnonzero(once), np.flatnonzero(~once)
        rows, sums, mine = r[one], room[1, : len(one)], room[2, : len(one)]
        np.take(to, rows, axis=0, out=sums, mode="clip")
        sums += np.take(step, one, axis=0, out=mine, mode="clip")
        np.put(by_row, rows, sums.view(row))
        # two weights are added as one complex number
        np.add.at(flat, ((r[more] * (WIDTH // 2))[:, None] + pairs).ravel(), step[more].view("c8").ravel())


@dataclasses.dataclass
class Model:
    """What the driver holds: totals, weights of a bounded size, and at most ``HOT`` counts."""

    n: int
    v: int
    hot: np.ndarray  # hashes, sorted
    hot_counts: np.ndarray
    own: np.ndarray  # hashes of the words with a place of their own, sorted
    own_code: np.ndarray
    prior: np.ndarray  # NODES x WIDTH: log share of each branch by the counts
    weights: np.ndarray = None  # rows x WIDTH
    seen: np.ndarray = None  # a row's squared gradients so far

    def start(self) -> None:
        bits = min(max(int(self.v).bit_length(), LEAST_ROWS), MOST_ROWS)
        self.weights, self.seen = np.zeros((1 << bits, WIDTH), "f4"), np.zeros(1 << bits, "f4")

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The codes of tokens' places; words with their own are looked up by the first bits of their hash."""
        first = (h >> np.uint64(48)).astype(np.int64)
        size = np.bincount((self.own >> np.uint64(48)).astype(np.int64), minlength=SHARED)
        start, out, more = np.cumsum(size) - size, FIRST[3] | first, size[first]
        for k in range(size.max()):
            some = np.flatnonzero(more > k)
            at = start[first[some]] + k
            same = self.own[at] == h[some]
            out[some[same]] = self.own_code[at[same]]
        return out

    def steps(self, code: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, ...]:
        """The nodes on the tokens' ways: token, node, branch, and the row of weights for each context."""
        first = code >> 16
        every = np.arange(len(code))
        at = [every, every, *[np.flatnonzero(first >= f >> 16) for f in FIRST[1:]]]
        on = [code[a] for a in at]
        node = np.concatenate([ABOVE[k] + (c >> (20 - 4 * k)) for k, c in enumerate(on)])
        branch = np.concatenate([(c >> (16 - 4 * k)) & 15 for k, c in enumerate(on)])
        token = np.concatenate(at)
        key = node.astype(np.uint64) * _GOLD
        shift = np.uint64(65 - len(self.weights).bit_length())
        rows = [(((c[token] ^ key) * _SPREAD) >> shift).astype(np.int64) for c in ctx]
        return token, node, branch, rows

    def odds(self, node: np.ndarray, rows: list[np.ndarray], room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The softmax at each node before division, given the rows of weights, and what to divide it by; in ``room``."""
        z, w = room[0, : len(node)], room[1, : len(node)]
        np.take(self.prior, node, axis=0, out=z, mode="clip")
        for r in rows:
            z += np.take(self.weights, r, axis=0, out=w, mode="clip")
        if len(z) and z.max() > 60:
            np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        return z, z @ _ONES

    def chances(self, node: np.ndarray, rows: list[np.ndarray], room: np.ndarray | None = None) -> np.ndarray:
        """The softmax at each node, given the rows of weights."""
        out, room = np.empty((len(node), WIDTH), "f4"), _room() if room is None else room
        for a in range(0, len(node), BLOCK):
            b = slice(a, a + BLOCK)
            z, total = self.odds(node[b], [r[b] for r in rows], room)
            np.divide(z, total[:, None], out=out[b])
        return out

    def chance(self, node: np.ndarray, branch: np.ndarray, rows: list[np.ndarray], room: np.ndarray) -> np.ndarray:
        """The chance of one branch at each node."""
        out = np.empty(len(node), "f4")
        for a in range(0, len(node), BLOCK):
            b = slice(a, a + BLOCK)
            z, total = self.odds(node[b], [r[b] for r in rows], room)
            out[b] = z.reshape(-1)[np.arange(0, z.size, WIDTH) + branch[b]] / total
        return out

    def gains(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per token the log10 of its place's chance over the place's share of the counts."""
        code = self.codes(h)
        ctx, out, room = contexts(h, code, counts), np.empty(len(h)), _room()
        for a in range(0, len(h), BATCH):
            b = slice(a, a + BATCH)
            token, node, branch, rows = self.steps(code[b], ctx[:, b])
            p = self.chance(node, branch, rows, room)
            gain = np.log(np.maximum(p, 1e-30)) - self.prior[node, branch]
            out[b] = np.bincount(token, gain, minlength=len(code[b]))
        return out / np.log(10)

    def train(self, h: np.ndarray, counts: np.ndarray, batch: int = BATCH, rate: float = RATE) -> None:
        """Gradient steps over the tokens, a batch at a time; a row's rate falls with its squared gradients."""
        code = self.codes(h)
        ctx, room, last = contexts(h, code, counts), _room(), np.empty(len(self.weights), "i4")
        # an array that was sent to a worker has a type object of its own; with two such objects np.add.at casts, forty times slower
        seen = self.seen.view("f4")
        for a in range(0, len(h), batch):
            b = slice(a, a + batch)
            _, node, branch, rows = self.steps(code[b], ctx[:, b])
            g = self.chances(node, rows, room)
            np.negative(g, out=g)
            g.reshape(-1)[np.arange(0, g.size, WIDTH) + branch] += 1
            square = np.einsum("ij,ij->i", g, g)
            for r in rows:
                np.add.at(seen, r, square)
                _add_rows(self.weights, r, g, np.float32(rate) / np.sqrt(seen[r] + 1), last, room)


def _training() -> Column:
    return ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(documents: DataFrame) -> DataFrame:
    """``h, c``: the count of every word (by hash) and of the end in ``documents``, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [_tokens(data, offs)[0] for _, _, data, offs in words.slices(b.column("text"))]
            if hs:
                u, n = np.unique(np.concatenate(hs), return_counts=True)
                for a in range(0, len(u), 100_000):
                    s = slice(a, a + 100_000)
                    yield pa.record_batch([pa.array(u[s].view(np.int64)), pa.array(n[s].astype(np.int64))], ["h", "c"])

    small_batches(documents.sparkSession)
    rows = documents.select("text").mapInArrow(run, "h bigint, c bigint")
    return written(rows.groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")


def _counted(counts: DataFrame, hot: int) -> Model:
    """The totals, the commonest words, their places and the nodes' shares."""
    # 8 bins to a doubling: how many words are as common
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
    least, room = None, hot
    for r in bins:
        room -= r["v"]
        if room < 0:
            break
        least = r["least"]
    n, v = sum(r["n"] for r in bins), sum(r["v"] for r in bins)
    common = counts.where(F.col("c") >= least) if least is not None else counts.limit(0)
    common = common.toPandas().sort_values(["c", "h"], ascending=[False, True])
    h, c = common["h"].to_numpy().astype(np.int64).view(np.uint64), common["c"].to_numpy().astype(np.int64)
    mass = counts.groupBy(F.shiftrightunsigned("h", 48).alias("place")).agg(F.sum(F.col("c") + 0.5).alias("m"), F.max(F.when(F.col("h") == _END_LONG, F.col("c"))).alias("end")).toPandas()
    shared = np.full(SHARED, 0.5 / SHARED)
    shared[mass["place"].to_numpy(np.int64)] += mass["m"].to_numpy(float)
    ends = float(np.nan_to_num(mass["end"].to_numpy(float)).max()) if len(mass) else 0.0
    words_ = np.flatnonzero(h != END)[: sum(OWN) - 1]
    own, own_mass = np.append(END, h[words_]), np.append(ends, c[words_]) + 0.5
    np.subtract.at(shared, (own >> np.uint64(48)).astype(np.int64), own_mass)
    code, at = np.empty(len(own), np.int64), 0
    for size, first, low in zip(OWN, FIRST, (12, 8, 4), strict=False):
        k = min(size, len(own) - at)
        code[at : at + k] = first + (np.arange(k) << low)
        at += k
    order, by = np.argsort(h), np.argsort(own)
    return Model(int(n), int(v), h[order], c[order], own[by], code[by], _prior(code, own_mass, np.maximum(shared, 1e-9)))


def _prior(code: np.ndarray, mass: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The log shares of every node's branches: masses of places added up towards the root."""
    codes, masses = np.append(code, FIRST[3] + np.arange(SHARED)), np.append(mass, shared)
    depth, out = DEPTH[codes >> 16], np.zeros((NODES, WIDTH), "f4")
    for k in range(LEVELS):
        on = depth > k
        below = np.bincount(codes[on] >> (16 - 4 * k), masses[on], minlength=WIDTH ** (k + 1)).reshape(-1, WIDTH) + 1e-9
        out[ABOVE[k] : ABOVE[k] + len(below)] = np.log(below / below.sum(axis=1, keepdims=True))
    return out


def _moved(model: Model, start: np.ndarray, before: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    """What a task has learned: the rows that it moved, in blocks."""
    s = model.seen - before
    for block, rows in enumerate(np.array_split(np.arange(len(s), dtype="<i4"), BLOCKS)):
        rows = rows[s[rows] > 0]
        if len(rows):
            parts = rows, (model.weights[rows] - start[rows]).astype("<f2"), s[rows].astype("<f4"), (s[rows] ** 2).astype("<f4")
            yield pa.record_batch([pa.array([task], pa.int32()), pa.array([block], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["task", "block", *_PARTS])


_PARTS = ("rows", "delta", "s", "s2")
_MOVED = "task int, block int, rows binary, delta binary, s binary, s2 binary"


def _put_together(t: pa.Table) -> pa.Table:
    """One block of several tasks as one: movements weighted by squared gradients."""
    kinds = dict(zip(_PARTS, ("<i4", "<f2", "<f4", "<f4"), strict=True))
    read = [[np.frombuffer(x.as_buffer(), kinds[p]) for x in t.column(p)] for p in _PARTS]
    rows, at = np.unique(np.concatenate(read[0]), return_inverse=True)
    s = np.concatenate(read[2])
    delta = np.concatenate(read[1]).reshape(-1, WIDTH).astype(float) * s[:, None]
    total, square = np.bincount(at, s), np.bincount(at, np.concatenate(read[3]))
    mean = np.stack([np.bincount(at, delta[:, k]) for k in range(WIDTH)], axis=1) / total[:, None]
    out = rows.astype("<i4"), mean.astype("<f2"), total.astype("<f4"), square.astype("<f4")
    return pa.table({"task": t.column("task").slice(0, 1), "block": t.column("block").slice(0, 1)} | {p: pa.array([x.tobytes()], pa.binary()) for p, x in zip(_PARTS, out, strict=True)})


def _take_in(model: Model, rows: np.ndarray, mean: np.ndarray, s: np.ndarray, s2: np.ndarray) -> None:
    """Move the model's weights by the tasks' mean, or by more where each has seen little."""
    tasks, each = s * s / np.maximum(s2, 1e-12), s2 / np.maximum(s, 1e-12)
    more = 1 + (np.sqrt(np.maximum(tasks, 1)) - 1) / (1 + each / SURE)
    model.weights[rows] += mean * more[:, None]
    model.seen[rows] += each


def fit(documents: DataFrame, counts: DataFrame, rounds: int = ROUNDS, hot: int = HOT, batch: int = BATCH, task_tokens: int = TASK_TOKENS) -> Model:
    """Train on all ``documents(doc_id, text)``, each in one of ``rounds`` rounds.

    A task trains on about ``task_tokens`` tokens (or one file split, if that is more)
    from the weights of the round before; with little input there are as many tasks as
    cores. The rows that tasks moved are merged block by block, ``FAN`` tasks at a time,
    so a merge is bounded whatever the input. The driver gets the merged rows: 12 MB a
    round at most.
    """
    spark = documents.sparkSession
    model = _counted(counts, hot)
    model.start()
    tasks = max(1, spark.sparkContext.defaultParallelism, -(-model.n // (task_tokens * rounds)))
    for k in range(rounds):
        mine = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("text").coalesce(tasks)
        known = spark.sparkContext.broadcast(dataclasses.replace(model, hot=model.hot[:0], hot_counts=model.hot_counts[:0]))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            m = dataclasses.replace(known.value, weights=known.value.weights.copy(), seen=known.value.seen.copy())
            for b in batches:
                for _, _, data, offs in words.slices(b.column("text")):
                    h, _, sizes = _tokens(data, offs)
                    m.train(h, sizes, batch)
            yield from _moved(m, known.value.weights, known.value.seen, TaskContext.get().partitionId())

        parts, moved = mine.rdd.getNumPartitions(), mine.mapInArrow(run, _MOVED)
        while parts > 1:
            moved = moved.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task", "block").applyInArrow(_put_together, _MOVED)
            parts = -(-parts // FAN)
        for r in moved.collect():
            _take_in(model, *_read(r))
        known.unpersist()
    return model


def _read(r) -> tuple[np.ndarray, ...]:
    """A merged block's rows, mean movements, and sums of squared gradients and of their squares."""
    return np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["delta"], "<f2").reshape(-1, WIDTH).astype("f4"), np.frombuffer(r["s"], "<f4"), np.frombuffer(r["s2"], "<f4")


def score_documents(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Score whole texts: ``doc_id, n_tokens, n_known, base_score, score``, log10 chances.

    ``base_score`` is the smoothed unigram score by ``counts``, ``score`` the model's. A
    null or empty text is the end alone. Repeated rows and ids are each scored. An empty
    table gives no rows; without training words every base score is 0. Other columns are
    ignored.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    known = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, row = known.value, TaskContext.get().partitionId() << 36
        log_hot = np.log10(m.hot_counts + 0.5)
        names = ["row", "doc_id", "n", "h", "known", "logs", "gain"]
        for b in batches:
            ids = b.column("doc_id")
            for at, to, data, offs in words.slices(b.column("text")):
                h, of, counts_ = _tokens(data, offs)
                n = to - at
                gain = np.bincount(of, m.gains(h, counts_), minlength=n)
                u, inverse = np.unique(h, return_inverse=True)
                place = np.minimum(np.searchsorted(m.hot, u), max(0, len(m.hot) - 1))
                hot = m.hot[place] == u if len(m.hot) else np.zeros(len(u), bool)
                logs = np.where(hot, log_hot[place], 0.0) if len(m.hot) else np.zeros(len(u))
                is_hot = hot[inverse]
                yield pa.record_batch(
                    [pa.array(row + np.arange(n)), ids.slice(at, n), pa.array(counts_.astype(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.bincount(of[is_hot], minlength=n).astype(np.int64)), pa.array(np.bincount(of, logs[inverse], minlength=n)), pa.array(gain)], names
                )
                key, times = np.unique(of[~is_hot] * len(u) + inverse[~is_hot], return_counts=True)
                k = len(key)
                if k:
                    nulls = pa.nulls(k, pa.float64())
                    yield pa.record_batch([pa.array(row + key // len(u)), pa.nulls(k, ids.type), pa.array(times.astype(np.int64)), pa.array(u[key % len(u)].view(np.int64)), pa.nulls(k, pa.int64()), nulls, nulls], names)
                row += n

    rows = documents.select("doc_id", "text").mapInArrow(run, f"row bigint, doc_id {id_type}, n bigint, h bigint, known bigint, logs double, gain double")
    rows = written(rows, "lm-rows")
    rare = rows.where("h is not null").select("row", "n", "h").join(counts.select("h", "c"), "h", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("rare_logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    docs = rows.where("h is null").join(rare, "row", "left")
    total = float(np.log10(model.n + 0.5 * (model.v + 1)))
    docs = docs.withColumn("base_score", F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n") * total)
    return docs.select("doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = documents.where(_training())
    counts = count_words(train)
    model = fit(train, counts)
    scored = score_documents(documents, model, counts)
    each = [(F.col(c) / F.col("n_tokens")).alias(name) for c, name in (("score", "token_score"), ("base_score", "token_base_score"))]
    return scored.select("doc_id", (~_training()).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score", *each)
