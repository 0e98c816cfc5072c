"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    out = []
    order = sorted(range(len(names)), key=lambda i: names[i])
    for r in data:
        row = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else round(v, 9)
            elif isinstance(v, (list, tuple)):
                v = tuple(v)
            row.append((v is not None, v if v is not None else 0))
        out.append(tuple(row))
    return sorted(out, key=repr)


def expected(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows(names, got.fetchall())


def actual(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
