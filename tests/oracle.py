"""Runs a query and its oracle on the smallest tables and compares the rows."""

import os

DATA = os.environ.get("SVLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return list(v) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = query(spark, DATA)
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, expected.fetchall())
