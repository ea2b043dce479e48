import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["multiway_join", "antijoin", "or_merge", "int_div", "real_div0", "ancestor", "two_strata", "dec_unique_min", "sess_watch", "latin_square", "most_queens", "part_bins", "pick_one_count", "map_inks", "min_cut", "sess_program_swap", "sess_save_load", "sess_output_update", "dec_unconditional", "round_trips", *(n for n in entry.queries() if n.startswith("refuse_")), "circuit_terms", "constraint_groups", "real_nan"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    order = sorted(got.columns)
    assert key(got.select(*order).toPandas().itertuples(index=False)) == key(want[order].itertuples(index=False))
