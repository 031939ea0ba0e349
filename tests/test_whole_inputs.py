"""Queries over all of their input, against the registered SQL without its cuts."""

import os

import duckdb
import pytest

from wavesift.plans import registry

SF = "/root/testdata/sf0.001"
CUTS = {
    "parse_answer_first_letter": ("substr(text, 1, 400)", "text"),
    "subtitle_interval_join": (" where event_id % 3 = 0", ""),
    "subtitle_cover_semi": (" where event_id % 3 = 0", ""),
    "subtitle_interleave": (" where event_id % 3 = 0", ""),
    "task_expand_recursive": (" where c_custkey % 10 = 0", ""),
}


@pytest.mark.parametrize("name", sorted(CUTS))
def test_rows_of_the_whole_input(spark, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {','.join(columns)} from ({registry.oracle_sql()[name].replace(*CUTS[name])})").fetchall()
    assert sorted(map(repr, [tuple(r[c] for c in columns) for r in df.collect()])) == sorted(map(repr, want))
