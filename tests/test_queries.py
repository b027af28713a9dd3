import os

import duckdb
import pytest

import queries as q
import store_queries as stores

EVERY, SQL = q.queries() | stores.queries(), q.oracle_sql() | stores.oracle_sql()
SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "documents", "conversations", "customer", "supplier", "part", "nation")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(EVERY))
def test_query_against_its_sql(spark, oracle, name):
    got = EVERY[name](spark, SF)
    want = oracle.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect())))
    right = sorted(map(str, oracle.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()))
    assert left == right


def test_native_bounds_reach_the_files(spark):
    plan = q.queries()["row_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "LessThanOrEqual(o_orderkey,200)" in plan
    plan = q.queries()["access_group_prune"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "l_tax" not in plan


def test_names_are_unique():
    assert not set(q.queries()) & set(stores.queries()) and set(EVERY) == set(SQL)


def test_lines_are_numbered_by_the_names_of_parts(spark, tmp_path):
    """Parts and splits are read by size: here the last part is the largest, the first the smallest."""
    rows = spark.range(0, 3000, 1, 3).selectExpr("concat(lpad(id, 4, '0'), repeat('x', int(id div 1000 * 50))) AS line")
    rows.write.text(str(tmp_path / "out"))
    want = [(n, f"{n:04d}" + "x" * (n // 1000 * 50)) for n in range(3000)]
    for size in ("128m", "10000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = stores.numbered(spark, str(tmp_path / "out")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(map(tuple, got)) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_merge_order_of_several_parts(spark):
    """Enough cells that the sorted folder has parts of several sizes."""
    c = duckdb.connect()
    c.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet'")
    got = EVERY["merge_order"](spark, "/root/testdata/sf0.1").select("n", "line").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(f"SELECT n, line FROM ({SQL['merge_order']})").fetchall())
