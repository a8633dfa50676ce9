"""Compares a query's rows with those of its SQL in DuckDB: columns by name, rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, bool) or x is None:
        return str(x)
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """None if both agree, else a short text."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    odd = [x for x in got[1] if x not in set(want[1])][:2], [x for x in want[1] if x not in set(got[1])][:2]
    return f"{len(got[1])} and {len(want[1])} rows; {odd}"
