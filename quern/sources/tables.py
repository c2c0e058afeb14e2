"""Tables: readers, and named tables kept as Parquet snapshots.

A table is a set of folders, each written once and never overwritten; a log beside the
tables says which folders count. Rows that changed are written as a folder more, with the
keys of the rows they replace.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.relational import coerce_number

SAMPLE = 100
LOG, SEQ = "_log", "_seq"
#: Folders a table is spread over at most; keys that a reader looks up by a broadcast table at most.
MOST_PARTS, BROADCAST_ROWS = 24, 200_000


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, sample: int | None = SAMPLE, blank_as_zero: bool = False) -> DataFrame:
    """A CSV file with a header; types from the first ``sample`` rows (all for None).

    A column is bigint if every cell that isn't blank is an integer, else double if every
    one is a number, else string. Blanks are null, or 0, 0.0 and "" if asked for.
    """
    raw = spark.read.csv(path, header=True, mode="FAILFAST", multiLine=True, escape='"')
    seen = raw.limit(sample) if sample is not None else raw
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    fits = lambda c, t: F.coalesce(F.bool_and(F.when(~blank(c), F.col(c).try_cast(t).isNotNull())), F.lit(True))
    checks = [f for c in raw.columns for f in (fits(f"`{c}`", "bigint").alias(f"i:{c}"), fits(f"`{c}`", "double").alias(f"d:{c}"))]
    kind = seen.agg(*checks).first() if checks else {}
    out = []
    for c in raw.columns:
        t, zero = ("bigint", 0) if kind[f"i:{c}"] else ("double", 0.0) if kind[f"d:{c}"] else ("string", "")
        cell = F.col(f"`{c}`") if t == "string" else F.when(~blank(f"`{c}`"), F.col(f"`{c}`").try_cast(t))
        out.append((F.coalesce(cell, F.lit(zero).cast(t)) if blank_as_zero else cell).alias(c))
    return raw.select(*out)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: ``path, content``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def epoch_seconds(df: DataFrame, column: str) -> DataFrame:
    """A column of seconds since 1970 as a timestamp without zone."""
    return df.withColumn(column, F.timestamp_seconds(column).cast("timestamp_ntz"))


class Tables:
    """Named tables below a folder that Hadoop's file systems reach.

    The folder's log has a file for each state of all its tables, numbered; the newest
    that is whole counts. A step writes its data first and then one file of the log, so
    a step that breaks off anywhere, or loses a race with another, changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        """The log's numbers, newest first."""
        fs, p = self._fs(f"{self.root}/{LOG}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit()), reverse=True)

    def _log_path(self, number: int) -> str:
        return f"{self.root}/{LOG}/{number:020d}.json"

    def state(self) -> tuple[int, dict[str, dict]]:
        """The log's last number, and the newest whole state: what is known of each table."""
        numbers = self._numbers()
        for n in numbers:
            found = self._state_of(n)
            if found is not None:
                return numbers[0], found
        return (numbers[0] if numbers else 0), {}

    def _state_of(self, number: int) -> dict[str, dict] | None:
        """The state in a file of the log; None where its writer broke off within it."""
        fs, p = self._fs(self._log_path(number))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _commit(self, number: int, state: dict[str, dict]) -> None:
        """Make a state the one that counts; raises if another step took the number."""
        fs, p = self._fs(self._log_path(number))
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _meta(self, name: str) -> dict:
        found = self.state()[1].get(name)
        if found is None:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return found

    def step(self) -> Step:
        """A step over any number of tables: ``with tables.step() as s: s.append(...); s.replace(...)``."""
        return Step(self)

    def exists(self, name: str) -> bool:
        return name in self.state()[1]

    def names(self) -> list[str]:
        return sorted(self.state()[1])

    def create(self, name: str, schema: StructType) -> None:
        """An empty table; its schema holds for all that is appended."""
        with self.step() as s:
            s.create(name, schema)

    def open(self, name: str) -> DataFrame:
        return self._read(self._meta(name))

    def _read(self, meta: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(meta["schema"]))
        if not meta["parts"]:
            return self.spark.createDataFrame([], schema)
        if not meta["dead"]:
            return self.spark.read.schema(schema).parquet(*[p["path"] for p in meta["parts"]])
        read = lambda p, s: self.spark.read.schema(s).parquet(p["path"]).withColumn(SEQ, F.lit(p["seq"]))
        rows = functools.reduce(DataFrame.unionByName, [read(p, schema) for p in meta["parts"]])
        key = StructType([schema[k] for k in meta["key"]])
        dead = functools.reduce(DataFrame.unionByName, [read(p, key) for p in meta["dead"]])
        dead = dead.select(*[F.col(k).alias(f"_dead_{k}") for k in meta["key"]], F.col(SEQ).alias(f"_dead{SEQ}"))
        if sum(p["rows"] for p in meta["dead"]) <= BROADCAST_ROWS:
            dead = F.broadcast(dead)
        gone = F.col(SEQ) < F.col(f"_dead{SEQ}")
        for k in meta["key"]:
            gone = F.col(k).eqNullSafe(F.col(f"_dead_{k}")) & gone
        return rows.join(dead, gone, "left_anti").select(*schema.names)

    def version(self, name: str) -> int:
        return self._meta(name)["version"]

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows of exactly the table's columns and types."""
        with self.step() as s:
            s.append(name, df)

    def replace(self, name: str, df: DataFrame, sort_by: list[str] | None = None) -> None:
        """A new snapshot in place of all rows; sorted, Parquet's statistics skip more."""
        with self.step() as s:
            s.replace(name, df, sort_by)

    def upsert(self, name: str, rows: DataFrame, gone: DataFrame, key: list[str]) -> None:
        """Rows in place of those whose key is in ``gone``."""
        with self.step() as s:
            s.upsert(name, rows, gone, key)

    def info(self, name: str) -> dict:
        meta, df = self._meta(name), self.open(name)
        size = 0
        for part in [*meta["parts"], *meta["dead"]]:
            fs, p = self._fs(part["path"])
            size += fs.getContentSummary(p).getLength()
        return {"name": name, "columns": [(f.name, f.dataType.simpleString()) for f in df.schema], "rows": df.count(), "version": meta["version"], "bytes": size}

    def vacuum(self, keep: int = 2) -> int:
        """Delete the log but for its newest ``keep`` whole states, and the data that none of those names; returns the folders deleted.

        Files that a writer broke off in count as no state. No step may be under way.
        """
        numbers, used, whole = self._numbers(), set(), 0
        for n in numbers:
            state = self._state_of(n) if whole < keep else None
            if state is not None:
                whole += 1
                used |= {part["path"] for meta in state.values() for part in [*meta["parts"], *meta["dead"]]}
            elif n != numbers[0]:  # the newest number stays taken
                fs, p = self._fs(self._log_path(n))
                fs.delete(p, False)
        gone = 0
        for name in self.names():
            fs, p = self._fs(f"{self.root}/{name}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if f"{self.root}/{name}/{s.getPath().getName()}" not in used:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone


class Step:
    """Changes of some tables that count together, once the step ends without an error."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def __enter__(self) -> Step:
        self.number, self.metas = self.tables.state()
        self.before = dict(self.metas)
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.metas != self.before:
            self.tables._commit(self.number + 1, self.metas)

    def open(self, name: str) -> DataFrame:
        """A table with what this step has done to it."""
        return self.tables._read(self.metas[name])

    def _part(self, name: str, df: DataFrame, seq: int) -> list[dict]:
        """Write rows as a new folder; none for no rows."""
        path = f"{self.tables.root}/{name}/v{seq}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        n = self.tables.spark.read.schema(df.schema).parquet(path).count()
        return [{"path": path, "rows": n, "seq": seq}] if n else []

    def create(self, name: str, schema: StructType) -> None:
        if name in self.metas:
            raise FileExistsError(name)
        self.metas[name] = {"version": 0, "parts": [], "dead": [], "key": [], "schema": schema.json()}

    def _checked(self, name: str, df: DataFrame) -> dict:
        meta = self.metas.get(name)
        if meta is None:
            raise FileNotFoundError(f"no table {name} in {self.tables.root}")
        schema = StructType.fromJson(json.loads(meta["schema"]))
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"the rows' schema is not that of {name}")
        return meta

    def append(self, name: str, df: DataFrame) -> None:
        meta = self._checked(name, df)
        seq = meta["version"] + 1
        self._settle(name, meta | {"version": seq, "parts": [*meta["parts"], *self._part(name, df, seq)]})

    def replace(self, name: str, df: DataFrame, sort_by: list[str] | None = None) -> None:
        seq = self.metas[name]["version"] + 1 if name in self.metas else 1
        out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
        self.metas[name] = {"version": seq, "parts": self._part(name, out, seq), "dead": [], "key": [], "schema": df.schema.json()}

    def upsert(self, name: str, rows: DataFrame, gone: DataFrame, key: list[str]) -> None:
        """Write ``rows`` and the keys of ``gone``: what a key had before is read no more.

        Only what changed is written, until a quarter of the rows is gone or parts are
        many; then the table is written anew. A table keeps to one key.
        """
        meta = self._checked(name, rows)
        if meta["dead"] and meta["key"] != key:
            raise ValueError(f"{name} is kept by {meta['key']}")
        seq = meta["version"] + 1
        dead = self._part(name, gone.select(*key).distinct(), seq)
        self._settle(name, meta | {"version": seq, "key": list(key), "parts": [*meta["parts"], *self._part(name, rows, seq)], "dead": [*meta["dead"], *dead]})

    def _settle(self, name: str, meta: dict) -> None:
        rows, dead = (sum(p["rows"] for p in meta[k]) for k in ("parts", "dead"))
        if len(meta["parts"]) + len(meta["dead"]) > MOST_PARTS or dead > max(1_000, rows // 4):
            meta = meta | {"parts": self._part(name, self.tables._read(meta), meta["version"]), "dead": []}
        self.metas[name] = meta


def cells_as_numbers(df: DataFrame) -> DataFrame:
    """Every column as double, what is no number as 0."""
    return df.select(*[coerce_number(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
