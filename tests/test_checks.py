"""Every query against its second, independent formulation."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def normal(rows, columns):
    def value(v):
        return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v

    order = sorted(columns)
    out = [tuple(value(r[columns.index(c)]) for c in order) for r in rows]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, db, sf, name):
    found = db.execute(CHECKS[name])
    columns, types = [c[0] for c in found.description], [str(c[1]) for c in found.description]
    want = normal(found.fetchall(), columns)
    df = QUERIES[name](spark, sf)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(columns, types))
    assert normal([tuple(r) for r in df.collect()], df.columns) == want


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_size_warnings_cover_every_brief(spark, db, sf):
    # briefs of sources with a number of documents divisible by five were left out: all of them at this size
    sources = {r[0] for r in db.execute("select distinct source from documents").fetchall()}
    assert {r.project_id for r in QUERIES["brief_size_warnings"](spark, sf).collect()} == sources
