import os

import duckdb
import pytest

from larkspur.plans import driver


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", list(driver.QUERIES))
def test_queries_equal_their_sql(spark, sf_dir, duck, name):
    got = driver.QUERIES[name](spark, sf_dir).toArrow()
    assert got.num_rows or name == "join_left_anti"
    if name not in driver.ORACLE_SQL:
        return
    duck.register("got", got)
    duck.sql(f"create or replace table wanted as {driver.ORACLE_SQL[name]}")
    kinds = [dict(r[:2] for r in duck.sql(f"describe {t}").fetchall()) for t in ("wanted", "got")]
    assert kinds[0] == kinds[1]
    columns = ", ".join(f'"{c}"' for c in sorted(kinds[0]))
    one, two = (f"select {columns} from {t}" for t in ("wanted", "got"))
    assert duck.sql(f"({one} except all {two}) union all ({two} except all {one})").fetchall() == []


def test_entry(spark, sf_dir):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lines_without_an_order_are_left_out(spark, sf_dir, tmp_path, duck):
    for name in ("lineitem", "orders", "customer", "nation", "part"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows = rows.where("o_orderkey % 10 <> 0") if name == "orders" else rows.where("p_partkey % 7 <> 0") if name == "part" else rows
        rows.write.parquet(f"file://{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "nation", "part"):
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("OP01_scan_aggregate", "OP04_groupby_high_cardinality", "OP10_distinct_count", "OP21_decimal_arithmetic"):
        con.register("got", driver.QUERIES[name](spark, f"file://{tmp_path}").toArrow())
        assert con.sql(f"(select columns(*) from ({driver.ORACLE_SQL[name]}) except all select * from got) limit 5").fetchall() == [], name
    assert con.sql("select count(*) from lineitem").fetchall()[0][0] > driver.QUERIES["OP01_scan_aggregate"](spark, f"file://{tmp_path}").first().count_rows
