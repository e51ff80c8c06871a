"""Compares a Spark query with its DuckDB SQL, column by column, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    return v


def rows_of(records, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = rows_of([dict(zip(names, r)) for r in cursor.fetchall()], columns)
    got = rows_of([r.asDict() for r in df.collect()], columns)
    assert got == want
