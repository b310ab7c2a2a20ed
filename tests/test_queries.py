"""Every query against its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert columns == sorted(theirs)
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain([[r[theirs.index(c)] for c in columns] for r in cursor.fetchall()])
