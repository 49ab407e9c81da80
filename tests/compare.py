"""Spark against DuckDB on the driver's tables: row count, names, and values as text."""

import re

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    norm = lambda rs: [tuple(f"{float(x):.6f}" if re.fullmatch(r"-?\d+\.?\d*", x) else x for x in r) for r in rs]
    assert norm(rows(got)) == norm(rows(want))
