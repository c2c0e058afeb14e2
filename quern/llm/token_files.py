"""Token ids in Arrow files of fixed-size-list batches.

A file holds the ids of some documents, one after another, cut into sequences of equal
length; the last is filled up and a mask says which ids count. Each record batch is one
block of memory, so sequence ``i`` of a mapped file is a slice and nothing is parsed or
copied. The documents' places are kept in a table beside the files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.plans.shared import fresh_path, small_batches, written

LENGTH, ROWS, END = 2048, 256, 2
#: Bytes of text a file is made of, about.
SHARD_BYTES = 128 << 20
#: Words and pieces whose ids a worker keeps: twice as many as elsewhere, as writing files leaves memory for them.
WORDS = 800_000


def _schema(length: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.uint16(), length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)])


def write_file(uri: str, docs: Iterator[bytes], length: int = LENGTH, rows: int = ROWS) -> tuple[int, int]:
    """Write the ids (unsigned 16-bit) of documents to a file; returns sequences and ids.

    The file gets its name when it is whole, so a task that is run again leaves the same
    file and a lost one leaves none.
    """
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part, schema, block = f"{path}.{uuid.uuid4().hex}", _schema(length), 2 * length * rows
    held, n_ids, n_rows = bytearray(), 0, 0

    def batch(ids: bytes) -> pa.RecordBatch:
        n = len(ids) // 2
        k = -(-n // length)
        values = np.zeros(k * length, "<u2")
        values[:n] = np.frombuffer(ids, "<u2")
        mask = np.arange(k * length) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (values, mask)]
        return pa.record_batch(lists, schema=schema)

    with fs.open_output_stream(part) as out, pa.ipc.new_file(out, schema) as to:
        for ids in docs:
            held += ids
            n_ids += len(ids) // 2
            while len(held) >= block:
                to.write_batch(batch(bytes(held[:block])))
                n_rows += rows
                del held[:block]
        if held:
            last = batch(bytes(held))
            to.write_batch(last)
            n_rows += last.num_rows
    fs.move(part, path)
    return n_rows, n_ids


class TokenFile:
    """Random access to a file: sequences, masks and runs of ids without reading the rest."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self._at = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self._file = pa.ipc.open_file(self._at)
        self.length = self._file.schema.field("ids").type.list_size
        self._rows = self._file.get_batch(0).num_rows if self._file.num_record_batches else 0
        self._last: tuple[int, np.ndarray, pa.Array] | None = None

    def _batch(self, i: int) -> tuple[int, np.ndarray, pa.Array]:
        if self._last is None or self._last[0] != i:
            b = self._file.get_batch(i)
            self._last = i, b.column("ids").flatten().to_numpy(zero_copy_only=True), b.column("mask")
        return self._last

    def sequence(self, i: int) -> np.ndarray:
        b, r = divmod(i, self._rows)
        return self._batch(b)[1][r * self.length : (r + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        b, r = divmod(i, self._rows)
        return self._batch(b)[2].slice(r, 1).flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, a slice of a batch at a time."""
        per = self._rows * self.length
        while n > 0:
            b, at = divmod(start, per)
            piece = self._batch(b)[1][at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def encode_to_files(documents: DataFrame, path: str | None = None, end: int = END, length: int = LENGTH, to: str | None = None) -> DataFrame:
    """Encode whole texts and write their ids to files in ascending order of doc_id.

    There are as many files as shuffle partitions, and more where one would be made of
    more than about ``SHARD_BYTES`` of text. Returns the index, a written table with a row a document: ``shard, uri, doc_id,
    local_start, n_tokens, start``; ``start`` counts the ids of all documents before it,
    in its own file and in those before. ``to`` is a folder all executors share.

    A null or empty text has the end id alone. A null doc_id comes first; equal ids are
    ordered by a hash of the text, equal rows are interchangeable. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    path, to = path or tokens.default_path(), to or fresh_path(spark, "token-files")
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    d = d.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), tokens.encoder(path, WORDS)
        tail = np.array([end], "<u2").tobytes()
        uri, ids, sizes = f"{to}/shard-{shard:06d}.arrow", [], []

        def docs() -> Iterator[bytes]:
            for b in batches:
                ids.append(b.column("doc_id"))
                for text in b.column("text"):
                    out = enc.encode(text.as_py()) + tail
                    sizes.append(len(out) // 2)
                    yield out

        first = next(it := docs(), None)
        if first is None:
            return
        write_file(uri, (x for y in ([first], it) for x in y), length)
        n = np.array(sizes, "int64")
        start, at = np.cumsum(n) - n, 0
        for x in ids:
            k = len(x)
            yield pa.record_batch([pa.array(np.full(k, shard, "int32")), pa.array([uri] * k), x, pa.array(start[at : at + k]), pa.array(n[at : at + k])], ["shard", "uri", "doc_id", "local_start", "n_tokens"])
            at += k

    id_type = documents.schema["doc_id"].dataType.simpleString()
    index = written(d.select("doc_id", "text").mapInArrow(write, f"shard int, uri string, doc_id {id_type}, local_start bigint, n_tokens bigint"), "token-index")
    # one row a file: the ids in the files before it
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard")) - F.col("n")
    shards = written(shards.select("shard", before.alias("base")), "token-shards")
    return index.join(F.broadcast(shards), "shard").select("shard", "uri", "doc_id", "local_start", "n_tokens", (F.col("base") + F.col("local_start")).alias("start"))


def read_digests(index: DataFrame) -> DataFrame:
    """Per row of an index, from its file: ``doc_id, start, n_tokens, ids_crc32``.

    The crc32 is over the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, TokenFile] = {}
        for b in batches:
            out = []
            for uri, at, n in zip(b.column("uri").to_pylist(), b.column("local_start").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                if uri not in files:
                    files.clear()
                    files[uri] = TokenFile(uri)
                crc = 0
                for piece in files[uri].ids(at, n):
                    crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                out.append(crc)
            yield pa.record_batch([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    id_type = index.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(encode_to_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
