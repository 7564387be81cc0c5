"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from daymark.plans import catalogue, more, records, shown, together  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted((repr(tuple(value(r[k]) for k in order)) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain(cur.fetchall(), names)
    assert got
