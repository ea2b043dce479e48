import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
#: name: the SQL for how many rows the query gives over its whole tables
WHOLE = {
    "timestamp_scan": "SELECT count(*) FROM events",
    "theta_join": "SELECT sum(s_nationkey) FROM supplier",
    "antijoin": "SELECT count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 25",
    "union_bodies": None,
    "intersect": "SELECT count(DISTINCT o_custkey) FROM orders",
    "difference": "SELECT count(*) FROM part WHERE p_size >= 12",
    "real_ops": None,
    "sess_insert_remove": None,
    "sess_watch": None,
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    rows = key(got.select(*order).toPandas().itertuples(index=False))
    assert rows == key(want[order].itertuples(index=False)) and rows
    if WHOLE[name]:
        assert len(rows) == con.execute(WHOLE[name]).fetchone()[0]
