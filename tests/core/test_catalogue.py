import os

import pytest

from lodestone import catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize(("name", "left", "right"), [("join_left_whole", True, False), ("join_right_whole", False, True), ("join_full_whole", True, True), ("join_full_whole_build_right", True, True)])
def test_outer_joins_over_whole_tables(spark, name, left, right):
    """Every row of an outer side is there once or more; every order at most once, as keys of customers are unique."""
    duckdb = pytest.importorskip("duckdb")
    got = catalogue.QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in got.collect()]
    con = duckdb.connect()
    for table in ("orders", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    assert sorted(rows, key=str) == sorted(con.execute(catalogue.ORACLES[name]).fetchall(), key=str)
    if left:
        assert len({r[0] for r in rows} - {None}) == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    if right:
        assert len({r[2] for r in rows} - {None}) == spark.read.parquet(f"{SF_DIR}/customer.parquet").count()
