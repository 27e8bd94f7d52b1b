"""Every registered query of the text operators against its SQL twin on the whole sf0.01 tables."""

import os

import duckdb
import pytest

from pitchlytics.llm import workload

SF_DIR = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("documents", "embeddings", "pages", "benchmark")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def as_text(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("~" if r[i] is None else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(workload.ORACLE))
def test_twin(spark, duck, name):
    df = workload.QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(workload.ORACLE[name])
    names, expected = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert expected, "an empty twin checks nothing"
    assert as_text(df.columns, [tuple(r) for r in df.collect()]) == as_text(names, expected)
