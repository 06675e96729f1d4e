"""Runs a registered query and its DuckDB SQL and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def check(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    found = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), found.columns)
