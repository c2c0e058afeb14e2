"""Command line: load, query, scan and info on tables; add, update, del, q and list on documents."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quern.functions.embedding import register_sql
from quern.operators.incremental import Engine
from quern.sources.tables import Tables, read_csv, read_texts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("--root", default="quern-data", help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {"load": ("table", "csv"), "query": ("sql",), "scan": ("table",), "info": ("table",), "add": ("id", "path"), "update": ("id", "path"), "del": ("id",), "q": ("text",), "list": ()}.items():
        s = sub.add_parser(name)
        for a in arguments:
            s.add_argument(a)
        s.add_argument("--limit", type=int, default=20)
    return p


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    tables = Tables(spark, a.root)
    if a.command == "load":
        tables.replace(a.table, read_csv(spark, a.csv))
    elif a.command == "query":
        register_sql(spark)
        for name in tables.names():
            tables.open(name).createOrReplaceTempView(name)
        spark.sql(a.sql).show(a.limit, truncate=False)
    elif a.command == "scan":
        tables.open(a.table).show(a.limit, truncate=False)
    elif a.command == "info":
        for k, v in tables.info(a.table).items():
            print(f"{k}: {v}")
    else:
        engine = Engine(spark, f"{a.root}/engine")
        if a.command in ("add", "update"):
            text = read_texts(spark, a.path).selectExpr(f"{int(a.id)}L AS document_id", "content")
            (engine.ingest if a.command == "add" else engine.update)(text).show()
        elif a.command == "del":
            engine.delete(spark.createDataFrame([(int(a.id),)], "document_id bigint")).show()
        elif a.command == "q":
            engine.search(a.text, a.limit).select("document_id", "chunk_id", "score", "content").show(truncate=80)
        else:
            engine.sources.orderBy("document_id").show(a.limit)


def main() -> int:
    spark = SparkSession.builder.appName("quern").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    except Exception as e:  # the command line's last resort
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
