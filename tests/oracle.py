"""Runs a query and its SQL over the same tables and compares the rows."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    c = duckdb.connect(config={"memory_limit": "8GB"})
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        return round(x, 6) + 0.0 if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x

    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(spark, query, sql, folder):
    df, want = query(spark, str(folder)), connection(folder).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def with_tables(folder, **frames):
    """The smallest tables with some of them replaced by Arrow tables."""
    import pyarrow.parquet as pq

    folder = Path(folder)
    for t in TABLES:
        if t in frames:
            pq.write_table(frames[t], folder / f"{t}.parquet")
        else:
            (folder / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    return folder
