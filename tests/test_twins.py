"""Every registered query of the library against its SQL twin on the whole sf0.01 tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pitchlytics.workload import oracle
from pitchlytics.workload.queries import QUERIES as LIBRARY

SF_DIR = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("lineitem", "orders", "supplier", "part")
TWINS = oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET memory_limit = '6GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def as_text(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("~" if r[i] is None else repr(r[i]) for i in order) for r in rows)


def test_every_twin_has_a_query():
    assert TWINS.keys() == LIBRARY.keys()
    assert not entry.oracle_sql().keys() - entry.queries().keys()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    df = LIBRARY[name](spark, SF_DIR)
    cursor = duck.execute(TWINS[name])
    names, expected = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert expected, "an empty twin checks nothing"
    assert as_text(df.columns, [tuple(r) for r in df.collect()]) == as_text(names, expected)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
