"""Every query with a SQL twin matches DuckDB on the smallest fixture
(row count, column names, order-insensitive values to 9 significant digits)."""

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        v = float(v)
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else float("%.9g" % v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(sdf.columns, srows) == _rows(dcols, drows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
