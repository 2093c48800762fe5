"""Every query against its SQL on the smallest tables."""

import math
import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def canonical(pdf):
    def cell(x):
        if x is None or str(x) in ("<NA>", "NaT") or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, float):
            return f"{x:.6g}"
        if isinstance(x, bool) or type(x).__name__ in ("bool_", "int64", "int32", "int8"):
            return str(int(x))
        return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, (str, bytes, dict)) else str(x)

    cols = sorted(pdf.columns)
    return cols, sorted("|".join(map(cell, r)) for r in pdf[cols].itertuples(index=False, name=None))


def catalog():
    from siftline.plans import catalog as c

    return c.queries(), c.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog()[1]))
def test_matches_sql(spark, duck, name):
    queries, sql = catalog()
    assert canonical(queries[name](spark, DIR).toPandas()) == canonical(duck.execute(sql[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog()[0]) - set(catalog()[1])))
def test_runs(spark, name):
    assert catalog()[0][name](spark, DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
