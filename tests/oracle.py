"""Compare a registered query with its SQL in DuckDB."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def _plain(x):
    return round(x, 6) if isinstance(x, float) else x


def differences(name, spark, sf="sf0.01"):
    import __spark_entry__ as e

    got = e.queries()[name](spark, f"{DATA}/{sf}")
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(e.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(got.columns) == cols, (got.columns, rel.columns)
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    rows = sorted((tuple(_plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    return [(a, b) for a, b in zip(rows, want, strict=False) if a != b][:3] + ([(len(rows), len(want))] if len(rows) != len(want) else [])
