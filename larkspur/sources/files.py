"""File sources and sinks of the generated tables: explicit schemas, Parquet, CSV with \\N for NULL, JSON lines, manifest."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

NULL_TEXT = "\\N"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

SCHEMAS = {
    "sales_fact": "transaction_id bigint, customer_id bigint, product_id bigint, store_id int, quantity int, unit_price decimal(18,2), discount double, tax double, country string, category string, transaction_date date, transaction_timestamp timestamp_ntz, is_returned boolean",
    "dim_customer": "customer_id bigint, name string, email string, signup_date date, segment string, country string, lifetime_value decimal(18,2)",
    "dim_product": "product_id bigint, category string, brand string, weight_grams int, tags array<string>, attributes map<string,string>",
    "events_log": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, payload_json string, session_id string, ip string, bytes bigint",
    "wide_numeric": "id bigint, " + ", ".join([f"f{c:03d} double" for c in range(100)] + [f"i{c:02d} bigint" for c in range(20)]),
}

RESULT_SCHEMA = (
    "run_id string, track string, implementation string, variant string, toolchain struct<name:string,version:string,flags:string>, op string, dataset string, rows bigint, mode string, "
    "chunk_rows bigint, threads int, status string, skip_reason string, correct boolean, checksum string, expected_checksum string, row_count bigint, startup_ms double, load_ms double, compute_ms double, "
    "total_ms double, runs array<double>, median_ms double, min_ms double, p95_ms double, iqr_pct double, noisy boolean, rows_per_s double, mb_per_s double, peak_rss_mb double, steady_rss_mb double, "
    "chunk_rows_per_s array<double>, env struct<cpu:string,cores:int,ram_gb:double,os:string,kernel:string,container_limits:string,disk:string,cache:string,governor:string>, notes string"
)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("errorifexists").option("compression", compression).parquet(path)


def write_noop(df: DataFrame) -> None:
    """Computes every row and keeps none."""
    df.write.format("noop").mode("overwrite").save()


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as compact JSON text."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Header, \\N for NULL, empty text unquoted, microsecond timestamps."""
    flat(df).write.options(header=True, nullValue=NULL_TEXT, emptyValue="", timestampNTZFormat=TIME_FORMAT, escape='"', quoteAll=False).csv(path)


def csv_text(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> DataFrame:
    """All fields as text with NULL and "" told apart.

    multi_line: fields may hold line ends, so each file is read by one task; where they hold none, False lets large files be split.

    The reader makes an empty field NULL and leaves \\N as text, so both are put right here. A field that spells \\N in
    quotes can't be told from NULL; the tables never hold one.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line, enforceSchema=True).schema(schema).csv(path)
    return rows.select(*[F.when(F.col(c).isNull(), "").when(F.col(c) != NULL_TEXT, F.col(c)).alias(c) for c in columns])


def typed(text: Column, kind: str) -> Column:
    if kind == "string":
        return text
    if kind == "timestamp_ntz":
        return F.to_timestamp_ntz(text, F.lit(TIME_FORMAT))
    if kind.startswith(("array", "map")):
        return F.from_json(text, kind)
    return text.cast(kind)


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Typed rows of a CSV folder; only the columns that a query uses are converted."""
    fields = StructType.fromDDL(schema).fields
    rows = csv_text(spark, path, [f.name for f in fields], multi_line)
    return rows.select(*[typed(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in fields])


def write_jsonl(records: list[dict], path: str | Path) -> None:
    with open(path, "a", encoding="utf-8") as out:
        for r in records:
            out.write(json.dumps(r, ensure_ascii=False) + "\n")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file for each partition, in a folder that all executors reach; path is a URI. A repeated task writes its file again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(folder)
        part, rows = TaskContext.get().partitionId(), 0
        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            with fs.open_output_stream(f"{folder}/part-{part:05d}.arrow") as sink, pa.ipc.new_file(sink, first.schema) as out:
                for batch in chain([first], batches):
                    out.write_batch(batch)
                    rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    df.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder of Arrow IPC files, file by file."""
    fs, folder = pa.fs.FileSystem.from_uri(path)
    names = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(folder)) if f.path.endswith(".arrow"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch[0].to_pylist():
                with fs.open_input_file(name) as source:
                    file = pa.ipc.open_file(source)
                    yield from (file.get_batch(i) for i in range(file.num_record_batches))

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return listed.mapInArrow(read, schema)


def file_hashes(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each data file of a folder, by name, taken where the files are read. The driver gets a row for each file."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return {r[0].rsplit("/", 1)[-1]: r[1] for r in rows.select("path", F.sha2("content", 256)).collect()}


def rows_by_file(df: DataFrame) -> dict[str, int]:
    """Rows of each file that df reads, by name."""
    return {r[0].rsplit("/", 1)[-1]: r[1] for r in df.groupBy(F.input_file_name()).count().collect()}


def manifest(table: str, rows: int, seed: int, digest: dict, form: str, schema: str, hashes: dict[str, str] | None = None, counts: dict[str, int] | None = None) -> dict:
    """What a written table is: its size, seed, schema and column digests (larkspur.digest), and each file's hash and rows."""
    listed = [{"name": n, "sha256": h, "rows": (counts or {}).get(n)} for n, h in sorted((hashes or {}).items())]
    return {"table": table, "rows": rows, "seed": seed, "format": form, "schema": schema, "columns": {k: {"sum": f"{s:016x}", "nulls": n} for k, (s, n) in digest.items()}, "files": listed}
