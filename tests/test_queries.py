"""Every query runs and is equal to its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if n not in ("op1_line_dedup", "op10_warc"))  # those are in tests/llm


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, name):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    rel = c.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[k]) for k in order) for r in df.collect())
    want = sorted(tuple(plain(dict(zip(rel.columns, r, strict=True))[k]) for k in order) for r in rel.fetchall())
    assert got == want


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
