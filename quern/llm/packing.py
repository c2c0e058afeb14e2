"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of binary lengths, the longest first: as many of
the full length as fit, then one for each set bit of the rest. Pieces of one length form
a bucket and are sequences of their own, so nothing is padded and no sequence crosses
documents. Each document is cut on its own: there is no shuffle. In what ``pack`` returns
a piece's bucket is a label, the top bits of its sequence id; ``write_buckets`` lays the
pieces down with a folder a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import tokens
from quern.plans.shared import small_batches

LONGEST, END = 2048, 1
_OUT = "start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of the pieces of ``n`` ids, in order; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(documents: DataFrame, path: str | None = None, end: int = END, longest: int = LONGEST) -> DataFrame:
    """Cut each row of ``documents(doc_id, text)`` into sequences.

    Returns a row a piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens,
    sequence_id, offset``; ``ids`` are little-endian unsigned 16-bit integers, the crc32
    is over them as unsigned 32-bit integers. A sequence is one piece, ``offset`` is 0. Sequence ids are unique, and ordered by bucket: the exponent
    of the length, then the task, then the place in it.

    A null or empty text is the end id alone. Repeated rows and ids are each packed. A
    null doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    path = path or tokens.default_path()
    small_batches(documents.sparkSession)
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc = TaskContext.get().partitionId(), tokens.encoder(path)
        tail = np.array([end], "<u2").tobytes()
        made = [0] * longest.bit_length()
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            at: list[int] = []
            for i, text in enumerate(b.column("text")):
                ids = enc.encode(text.as_py() or "") + tail
                n, start = len(ids) // 2, 0
                for k in binary_lengths(n, longest):
                    bucket = k.bit_length() - 1
                    sequence = (bucket << 58) | (task << 36) | made[bucket]
                    made[bucket] += 1
                    piece = ids[2 * start : 2 * (start + k)]
                    crc = zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes())
                    for column, x in zip(rows, (start, k, piece, crc, n, sequence, 0), strict=True):
                        column.append(x)
                    at.append(i)
                    start += k
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            arrays = [pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)]
            yield pa.record_batch([b.column("doc_id").take(pa.array(at, pa.int64())), *arrays], ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, {_OUT}")


def write_buckets(pieces: DataFrame, to: str) -> None:
    """Write what ``pack`` returns as Parquet, a folder a length, without a shuffle.

    A reader of one folder gets sequences of one length, ready to be batched. An empty
    table leaves an empty folder.
    """
    pieces.write.partitionBy("length").parquet(to)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
