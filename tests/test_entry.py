import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_flagship(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["snapshot_text", "mirror_latest", "relation_asof", "dlq_replay", "checkpoint_advance"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("events", "customer", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    mine = sorted(str([r[c] for c in cols]) for r in got.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(str([r[names.index(c)] for c in cols]) for r in cursor.fetchall())
    assert mine == theirs and mine
