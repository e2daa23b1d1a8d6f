"""File operations: write a frame, read it back, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalar import cents, price
from larkspur.operators.sales import scan_aggregate, summarise_columns
from larkspur.sources import files
from larkspur.storage import table_path

COLUMNS = "transaction_id bigint, customer_id bigint, product_id bigint, store_id int, quantity int, unit_price decimal(18,2), discount double, tax double, country string, category string, transaction_date date, transaction_timestamp timestamp_ntz, is_returned boolean"


def published(sales: DataFrame) -> DataFrame:
    """A sales frame with unit_price in place of cents, in the published column order."""
    rows = sales.withColumn("unit_price", price(F.col("cents")))
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (part.split(" ") for part in COLUMNS.split(", "))])


def framed(rows: DataFrame) -> DataFrame:
    """A published table as a sales frame."""
    return rows.withColumn("cents", cents(F.col("unit_price"))).drop("unit_price")


def parse_csv(spark: SparkSession, path: str) -> DataFrame:
    """Parses all columns of a CSV folder and sums each up."""
    return summarise_columns(framed(files.read_csv(spark, path, COLUMNS)))


def read_parquet_aggregate(spark: SparkSession, path: str) -> DataFrame:
    return scan_aggregate(framed(files.read_parquet(spark, path, COLUMNS, ["quantity", "unit_price", "is_returned"])))


def write_csv_parquet(sales: DataFrame) -> DataFrame:
    """Both written forms summed up, one row each."""
    spark, rows = sales.sparkSession, published(sales)
    csv, parquet = table_path(spark, "csv"), table_path(spark, "parquet")
    files.write_csv(rows, csv)
    files.write_parquet(rows, parquet)
    out = None
    for form, back in (("csv", files.read_csv(spark, csv, COLUMNS)), ("parquet", files.read_parquet(spark, parquet, COLUMNS))):
        one = summarise_columns(framed(back)).withColumn("form", F.lit(form))
        out = one if out is None else out.union(one)
    return out
