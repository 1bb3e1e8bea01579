"""Compare a query with its SQL twin on DuckDB."""

import glob
import os
import time

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark, sf_dir, function, sql, con):
    """Empty text if equal, else what differs."""
    started = time.time()
    df = function(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(str(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    took = time.time() - started
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}", took
    order = [theirs.index(n) for n in names]
    want = [tuple(str(row[i]) for i in order) for row in result.fetchall()]
    got.sort()
    want.sort()
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows", took
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(names, a))} and {dict(zip(names, b))}", took
    return ("" if got else "no rows at all"), took
