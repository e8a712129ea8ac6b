"""Runs a registered query on Spark and its oracle on DuckDB, and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

from textkin.plans.dialect import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def oracle(sql: str, sf_dir: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    return names, rel.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tzinfo") and v is not None:
        return v.replace(tzinfo=None).isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, plan, sql: str, sf_dir: str = DATA) -> None:
    df = plan(spark, sf_dir)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(*oracle(sql, sf_dir))
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        if repr(a) != repr(b):
            assert all(x == y or (isinstance(x, float | int) and isinstance(y, float | int) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)
