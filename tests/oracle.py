"""Rows of a query and of its SQL in a form that can be compared."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection():
    import duckdb

    c = duckdb.connect()
    c.sql("SET threads = 2")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)

    return [columns[i] for i in order], sorted(tuple(text(v[i]) for i in order) for v in values)


def same(spark, query, sql, c):
    df = query(spark, SF)
    r = c.sql(sql)
    assert rows(df.columns, df.collect()) == rows(r.columns, r.fetchall())
