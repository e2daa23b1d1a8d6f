import datetime
from decimal import Decimal

from larkspur import digest
from larkspur.operators.files import COLUMNS, framed
from larkspur.operators.sales import summarise_columns
from larkspur.sources import files
from larkspur.sources import generate as g
from larkspur.storage import table_path


def test_null_and_empty_survive_csv(spark):
    rows = [
        (2**53 + 1, 1, 1, 1, None, Decimal("0.29"), 0.1, 0.2, None, "a", datetime.date(1969, 12, 31), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), True),
        (2, 1, 1, 1, 5, Decimal("90071992547409.93"), 0.0, 0.0, "", 'x,"y"', datetime.date(2026, 1, 1), datetime.datetime(9999, 12, 31, 23, 59, 59, 999999), False),
        (3, 1, 1, 1, -5, Decimal("-0.01"), 0.0, 0.0, "Café", "é" * 20000, datetime.date(1970, 1, 1), datetime.datetime(1970, 1, 1), False),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    path = table_path(spark, "csv")
    files.write_csv(df, path)
    back = files.read_csv(spark, path, COLUMNS)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_foreign_csv_with_crlf_and_no_last_newline(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b,c\r\n1,\\N,"x,""y"""\r\n2,,z')
    rows = files.read_csv(spark, f"file://{tmp_path}", "a bigint, b string, c string").collect()
    assert sorted(map(tuple, rows)) == [(1, None, 'x,"y"'), (2, "", "z")]


def test_generated_tables_round_trip(spark):
    scale = g.Scale(1000)
    for table in ("sales_fact", "dim_product", "events_log"):
        frame = g.GENERATORS[table](spark, scale)
        wanted = digest.column_digests(frame)
        csv, parquet = table_path(spark, table), table_path(spark, table)
        files.write_csv(frame, csv)
        files.write_parquet(frame, parquet)
        assert digest.column_digests(files.read_csv(spark, csv, files.SCHEMAS[table])) == wanted, table
        assert digest.column_digests(files.read_parquet(spark, parquet, files.SCHEMAS[table])) == wanted, table


def test_parsed_sums_equal_those_of_the_source(spark):
    frame = g.sales_fact(spark, g.Scale(1000))
    path = table_path(spark, "csv")
    files.write_csv(frame, path)
    assert summarise_columns(framed(files.read_csv(spark, path, COLUMNS))).first() == summarise_columns(framed(frame)).first()


def test_scans_read_only_what_is_used(spark):
    path = table_path(spark, "pruned")
    files.write_parquet(g.sales_fact(spark, g.Scale(1000)), path)
    plan = files.read_parquet(spark, path, COLUMNS).where("customer_id = 5").select("quantity")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<customer_id:bigint,quantity:int>" in plan and "EqualTo(customer_id,5)" in plan


def test_clear_removes_intermediate_tables(spark, tmp_path, monkeypatch):
    from larkspur import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    spark.range(3).write.parquet(storage.table_path(spark, "t"))
    assert list((tmp_path / "larkspur").iterdir())
    storage.clear(spark)
    assert not (tmp_path / "larkspur").exists()


def test_a_folder_is_made_only_where_none_is_named(spark, monkeypatch):
    from types import SimpleNamespace

    from larkspur import storage

    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    made = []
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getConf=dict, applicationId="a", master="local[2]", setCheckpointDir=made.append))
    assert storage.shared_dir(bare) == storage.shared_dir(bare) == made[0] and len(made) == 1
    bare.sparkContext.master, bare.sparkContext.applicationId = "yarn", "b"
    try:
        storage.shared_dir(bare)
        raise AssertionError
    except RuntimeError:
        pass


def test_line_ends_within_csv_fields(spark):
    rows = [(1, "two\nlines"), (2, 'a "quoted"\r\nend'), (3, None), (4, "")]
    path = table_path(spark, "csv")
    files.write_csv(spark.createDataFrame(rows, "a bigint, b string"), path)
    assert sorted(map(tuple, files.read_csv(spark, path, "a bigint, b string").collect())) == rows


def test_arrow_files_round_trip(spark, tmp_path):
    frame = g.sales_fact(spark, g.Scale(1000)).repartition(3)
    files.write_arrow(frame, (tmp_path / "a").as_uri())
    assert len(list((tmp_path / "a").glob("*.arrow"))) == 3
    back = files.read_arrow(spark, (tmp_path / "a").as_uri(), files.SCHEMAS["sales_fact"])
    assert digest.column_digests(back) == digest.column_digests(frame)


def test_wide_rows_past_the_limit_on_demand(monkeypatch):
    monkeypatch.setattr(g, "WIDE_LIMIT", 10)
    assert g.Scale(50).table_rows("wide_numeric") == 10 and g.Scale(50, large_wide=True).table_rows("wide_numeric") == 50
