import duckdb
import pytest

import __spark_entry__ as entry
from leadloom import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_rows_equal_the_oracle(spark, sf, con, name):
    got = queries.queries()[name](spark, sf)
    cursor = con.execute(oracle.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(tuple(r[c] for c in names) for r in got.collect()) == key(cursor.fetchall())


def test_ingest_queries_agree(spark, sf):
    made = queries.ingest_result(spark, sf)
    assert {r.action for r in made.select("action").distinct().collect()} <= {"created", "updated", "skipped"}
    assert made.count() == queries.fixture.submissions(spark, sf).count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
