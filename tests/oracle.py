"""Compare a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    return tuple("NULL" if x is None else f"{x:.6g}" if isinstance(x, float) and math.isfinite(x) else str(x) for x in row)


def sql_rows(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(plain([r[k] for k in order]) for r in cur.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(plain(r) for r in df.select(*names).collect())
