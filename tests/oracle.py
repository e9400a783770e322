"""Compare a query's rows with those of its SQL, as sets of rounded values."""

from __future__ import annotations

import glob
import math
import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(v) if isinstance(v, list) else v


def rows_of_spark(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(_value(r[i]) for i in order) for r in found.fetchall()), key=repr)
