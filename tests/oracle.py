"""Spark queries held against their DuckDB SQL, as multisets of rows."""

import glob
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(p) or glob.glob(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def compare(spark, queries, sql, name, sf_dir, connection=None):
    c = connection or connect(sf_dir)
    df = queries[name](spark, sf_dir)
    order = sorted(df.columns)
    got = Counter(tuple(r[x] for x in order) for r in df.collect())
    rel = c.sql(sql[name])
    assert sorted(rel.columns) == order, (sorted(rel.columns), order)
    at = [rel.columns.index(x) for x in order]
    want = Counter(tuple(r[k] for k in at) for r in rel.fetchall())
    norm = lambda rows: Counter({tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else float(v) if type(v).__name__ == "Decimal" else v for v in r): n for r, n in rows.items()})
    got, want = norm(got), norm(want)
    assert got == want, f"{name}: {sum(got.values())} rows, {sum(want.values())} wanted; only got {list((got - want).items())[:3]}, only wanted {list((want - got).items())[:3]}"
    return sum(got.values())
