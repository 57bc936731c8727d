"""Every query with SQL gives DuckDB's rows; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from candor.queries import QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    try:
        return f"{float(v):.5f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, D)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if not q.sql:
        assert got
        return
    cursor = duck.execute(q.sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want
