"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from barleaf.plans import evaluation  # noqa: F401
from barleaf.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def normal(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return str(v)[:10] if hasattr(v, "year") else v

    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = normal(df.select(*(f"`{c}`" for c in columns)).collect())
    theirs = normal(duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})").fetchall())
    assert mine == theirs


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"walkforward_predictions", "permutation_importance"}
