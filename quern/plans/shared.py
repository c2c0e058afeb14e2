"""Tables that cut lineage, kept where every executor can read them.

The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset,
a session of one machine gets a folder of this machine; on a cluster that is an error.
What a session leaves in its folder goes when the session ends.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_RUNS: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Bytes of an Arrow batch that goes to a Python worker, where the session sets no less.
ARROW_BYTES = 4 << 20
#: Rows, and bytes of its files, up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path without a trailing slash."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quern-")
    return f"file://{_LOCAL[app]}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the session's own part of the shared folder that nothing has used yet."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}"
        fs, p = _path(spark, _RUNS[app])
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{_RUNS[app]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage: a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table for the small side of a join: broadcast if it has few rows and, where ``written`` made it, few bytes."""
    path = _PATHS.get(table)
    if path is not None:
        fs, p = _path(table.sparkSession, path)
        if fs.getContentSummary(p).getLength() > BROADCAST_BYTES:
            return table
    return F.broadcast(table) if table.count() <= rows else table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        path = _PATHS.pop(t, None)
        if path is not None:
            fs, p = _path(t.sparkSession, path)
            fs.delete(p, True)


def small_batches(spark: SparkSession | None = None) -> None:
    """Bound the session's Arrow batches (the active one's if none is given) by ``ARROW_BYTES``: long rows then fill no worker."""
    spark = spark or SparkSession.getActiveSession()
    if spark and spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > ARROW_BYTES:
        spark.conf.set(_BATCHES, str(ARROW_BYTES))
