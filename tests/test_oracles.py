"""Every query with a DuckDB twin gives the same rows on the small tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tracewright.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(int(v)) if v.is_integer() else f"{v:.6g}"
    return repr(v) if isinstance(v, (int, str, datetime.datetime)) else repr(list(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_duckdb(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = rows_of(got.columns, got.collect())
    assert rows[1] or name in ("first_trigger", "jaccard_pairs", "alpha_contexts")
    if name in catalog.oracle_sql():
        cur = duck.execute(catalog.oracle_sql()[name])
        want = rows_of([d[0] for d in cur.description], cur.fetchall())
        assert rows[0] == want[0]
        assert len(rows[1]) == len(want[1])
        wrong = [(a, b) for a, b in zip(rows[1], want[1]) if a != b]
        assert not wrong, wrong[:5]
