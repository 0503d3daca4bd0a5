"""Each query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from soundtable.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([canonical(r[c]) for c in columns] for r in got.collect()) == sorted([canonical(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_edits_keep_every_customer(spark):
    """Every customer whose last event is no delete stays."""
    con = duckdb.connect()
    want = con.sql(f"SELECT c_custkey FROM '{SF}/customer.parquet' EXCEPT SELECT user_id FROM '{SF}/events.parquet' GROUP BY 1 HAVING arg_max(event_type, event_id) = 'error'").fetchall()
    got = {r.track for r in QUERIES["apply_edits_whole"](spark, SF).select("track").collect()}
    assert len(want) and {k for (k,) in want} <= got
