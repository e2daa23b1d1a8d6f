"""Shared pieces of the training-data operators: materialising in the shared folder, key filters."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.storage import table_path

#: Word separators of every word-based contract: blank and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Positions of a key filter: 2**25 bits are 4 MB, whatever the number of keys.
FILTER_BITS = 1 << 25


#: Rows of an Arrow batch: whole texts go to Python and come back in pieces of a few MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS. It stays so, since frames returned here run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back at the end of a task; Python workers live on between tasks."""

    def wrapper(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return wrapper


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends in files that survive lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    small_batches(spark)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets shuffle files of finished jobs go: Spark removes them once the driver's JVM has collected their plans."""
    gc.collect()
    spark._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as the empty text.

    Texts without multi-byte characters take the cheaper general lower().
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """A filter over the 64-bit column key as at most FILTER_BITS / 32768 rows of 4 kB: (bucket, bits).

    The size is fixed, so it may be broadcast; more keys only let more strangers pass.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return (
        keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
    )


def maybe_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows of df whose 64-bit column key may be in the filter: every row whose key is, and few others."""
    return maybe_flag(df, key, bits, "__lk_flag").where("__lk_flag").drop("__lk_flag")


def written_by(df: DataFrame, name: str, key: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder (to path, if given) in buckets of key, one for each shuffle partition; rows are not moved.

    Two such tables, or one and an aggregate by key, join on key without moving their rows again.
    """
    spark = df.sparkSession
    table = f"larkspur_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    df.write.options(path=path or table_path(spark, name), compression="zstd").bucketBy(n, key).format("parquet").saveAsTable(table)
    return spark.table(table)


def maybe_flag(df: DataFrame, key: str, bits: DataFrame, flag: str) -> DataFrame:
    """df with a boolean column flag: true where the 64-bit column key may be in the filter, false where it is not."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    kept = df.columns
    df = df.withColumns({"__lk_bucket": F.bitmap_bucket_number(at), "__lk_at": F.bitmap_bit_position(at)})
    df = df.join(F.broadcast(bits.select(F.col("bucket").alias("__lk_bucket"), F.col("bits").alias("__lk_bits"))), "__lk_bucket", "left")
    byte = F.expr("cast(conv(hex(substring(__lk_bits, cast(__lk_at div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.call_function("bit_get", byte, F.expr("cast(__lk_at % 8 as int)")) == 1
    return df.select(*kept, F.coalesce(hit, F.lit(False)).alias(flag))
