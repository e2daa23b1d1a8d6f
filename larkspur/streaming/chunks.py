"""Structured Streaming forms of the aggregating operations: files arrive in bounded chunks, only groups are kept.

A micro-batch is a fixed number of files. Additive operations run as one streaming aggregation in complete mode, which
keeps a row for each group; the others run as streaming aggregations whose last states a batch step finishes, and a
filter runs in append mode. The file source and the state store make a restarted query go on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import sales as S
from larkspur.operators.files import framed
from larkspur.plans.registry import OPERATIONS, Operation
from larkspur.storage import table_path

#: Operations that are one streaming aggregation, and one that keeps no state.
WHOLE = ("OP01", "OP03", "OP04", "OP05", "OP06", "OP07", "OP15", "OP21", "OP22")
APPENDED = ("OP02",)


def _counted(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda sales: sales.groupBy(*keys).agg(F.count("*").alias("rows"))


def _distinct(customers: DataFrame, products: DataFrame, store_days: DataFrame) -> DataFrame:
    one = customers.agg(F.count("customer_id").alias("distinct_customers"))
    two = products.agg(F.count("product_id").alias("distinct_products"))
    return one.join(F.broadcast(two)).join(F.broadcast(store_days.agg(F.count("*").alias("distinct_store_days"))))


def _by_country(sales: DataFrame) -> DataFrame:
    return sales.groupBy("country").agg(F.count("*").alias("rows"), F.count_if(F.col("quantity").isNull()).alias("null_quantity"), S.total(F.coalesce("quantity", F.lit(1))).alias("sum_quantity_or_1"))


def _nulls(countries: DataFrame) -> DataFrame:
    named = F.col("country").isNotNull()
    rows = F.when(~named, F.col("rows")), F.when(named & (F.col("country") != ""), F.col("rows"))
    return countries.agg(F.coalesce(S.total("null_quantity"), F.lit(0)).alias("null_quantity"), *[F.coalesce(S.total(c), F.lit(0)).alias(n) for c, n in zip(rows[:1], ("null_country",))], S.total("sum_quantity_or_1").alias("sum_quantity_or_1"), F.coalesce(S.total(rows[1]), F.lit(0)).alias("count_country_nonempty"), F.count("country").alias("distinct_country"))


def _best(customers: DataFrame) -> DataFrame:
    return S.top_n(customers.withColumnRenamed("sum_price_cents", "cents"))


#: Operations as streaming aggregations and the batch step that finishes their states.
FINISHED = {
    "OP09": ((lambda sales: sales.groupBy("customer_id").agg(S.total("cents").alias("sum_price_cents")),), _best),
    "OP10": ((_counted("customer_id"), _counted("product_id"), _counted("store_id", "transaction_date")), _distinct),
    "OP19": ((_by_country,), _nulls),
}
STREAMED = (*WHOLE, *APPENDED, *FINISHED)


class NotStreamable(ValueError):
    pass


def sales_stream(spark: SparkSession, path: str, schema: str, files_per_chunk: int = 1) -> DataFrame:
    return framed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(path))


def drained(frame: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming frame over all files there are now; the result as a table of the last state."""
    spark, name = frame.sparkSession, f"chunks_{uuid.uuid4().hex}"
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", table_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def streamed(operation: Operation, sales: DataFrame, dims: list[DataFrame]) -> DataFrame:
    """An operation over a streaming sales frame, as micro-batches."""
    if operation.number in FINISHED:
        states, finish = FINISHED[operation.number]
        return finish(*[drained(state(sales)) for state in states])
    return drained(operation.run(sales, *dims), "append" if operation.number in APPENDED else "complete")


def run_streaming(spark: SparkSession, number: str, path: str, schema: str, dims: dict[str, DataFrame] | None = None, files_per_chunk: int = 1) -> DataFrame:
    """An operation over a folder of Parquet chunks, as micro-batches; refused where a total order is needed."""
    operation = OPERATIONS[number]
    if number not in STREAMED:
        raise NotStreamable(f"{number} {operation.name} needs a total order")
    sales = sales_stream(spark, path, schema, files_per_chunk).select(*operation.columns)
    return streamed(operation, sales, [(dims or {})[d] for d in operation.dims])


def latest_events(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream's events without repeats of an id within the watermark: out-of-order rows up to `late` still count."""
    return events.withColumn("time", events["ts"].cast("timestamp")).withWatermark("time", late).dropDuplicatesWithinWatermark(["event_id"]).drop("time")


def folded(frames: list[DataFrame], step: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Partial results of chunks merged once: for operations whose states merge but which no streaming plan allows."""
    out = None
    for frame in frames:
        part = step(frame)
        out = part if out is None else out.unionByName(part)
    return merge(out)
