import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


CHEAP = ["match_prune", "range_exclusive", "lookup_join_left", "row_index_per_split", "gap_fill", "crosstalk_runs", "weighted_frequency", "dense_id_map", "merge_shards", "violations_report", "p1_found"]


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    import glob
    import os

    import duckdb

    rows = entry.queries()[name](spark, DATA).collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    table = con.sql(sql)
    at = {c: i for i, c in enumerate(table.columns)}
    columns = sorted(at)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    ours = sorted(str([plain(r[c]) for c in columns]) for r in rows)
    theirs = sorted(str([plain(r[at[c]]) for c in columns]) for r in table.fetchall())
    assert ours == theirs
