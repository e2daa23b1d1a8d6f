"""The thirteen specified operations over a sales frame.

A sales frame has transaction_id, customer_id, product_id, store_id, quantity, cents, discount, tax, country, category,
transaction_date, transaction_timestamp and is_returned. Results hold bigint, text and NULL, and floats only in OP21.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import micros, millionths, money_text
from larkspur.functions.wrapping import unsigned, wrapping

#: A side is broadcast only up to this size, which is that of its files, several times as much in memory; beyond it Spark shuffles both.
BROADCAST_BYTES = 16 << 20


def total(column) -> F.Column:
    return F.sum(column).cast("bigint")


def small(df: DataFrame) -> DataFrame:
    """Marks a join side for broadcast if the optimiser's size estimate for it is below BROADCAST_BYTES."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST_BYTES else df


def scan_aggregate(sales: DataFrame) -> DataFrame:
    c = F.col("cents")
    return sales.agg(F.count("*").alias("count_rows"), F.count("quantity").alias("count_quantity"), total("quantity").alias("sum_quantity"), total(c).alias("sum_price_cents"), F.min(c).alias("min_price_cents"), F.max(c).alias("max_price_cents"), F.count_if("is_returned").alias("count_returned"))


def filter_project(sales: DataFrame, countries: tuple[str, ...] = ("Germany", "France", "Japan"), discount: float = 0.1) -> DataFrame:
    kept = ~F.col("is_returned") & (F.col("discount") > discount) & F.col("country").isin(*countries)
    return sales.where(kept).select("transaction_id", "customer_id", "cents", "country")


def groupby_low_cardinality(sales: DataFrame) -> DataFrame:
    return sales.groupBy("country").agg(F.count("*").alias("count_rows"), total("quantity").alias("sum_quantity"), total("cents").alias("sum_price_cents"))


def groupby_high_cardinality(sales: DataFrame) -> DataFrame:
    return sales.groupBy("customer_id").agg(F.count("*").alias("count_rows"), total("cents").alias("sum_price_cents"))


def groupby_multi_key(sales: DataFrame) -> DataFrame:
    return sales.groupBy("country", "category", F.year("transaction_date").cast("bigint").alias("year")).agg(F.count("*").alias("count_rows"), total("cents").alias("sum_price_cents"))


def hash_join_aggregate(sales: DataFrame, customers: DataFrame) -> DataFrame:
    joined = sales.join(small(customers.select("customer_id", "segment")), "customer_id")
    return joined.groupBy("segment").agg(F.count("*").alias("count_rows"), total("cents").alias("sum_price_cents"), total("quantity").alias("sum_quantity"))


def star_join_aggregate(sales: DataFrame, customers: DataFrame, products: DataFrame, segment: str = "enterprise") -> DataFrame:
    chosen = customers.where(F.col("segment") == segment).select("customer_id")
    joined = sales.join(small(chosen), "customer_id").join(small(products.select("product_id", "brand")), "product_id")
    return joined.groupBy("brand").agg(F.count("*").alias("count_rows"), total("cents").alias("sum_price_cents"))


def sort(sales: DataFrame, keys: tuple[str, ...] = ("transaction_timestamp", "transaction_id"), id_column: str = "transaction_id") -> DataFrame:
    """Full sort; first and last id and the sum of position times id modulo 2**64.

    Rows are dealt to sorted ranges and sorted there. A range's positions are its offset plus the place within it, so
    a range is summed as offset * sum(id) + sum(place * id); only one row for each range meets in the last step.
    """
    spark = sales.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with wrapping(spark):
        ranged = sales.select(*dict.fromkeys((*keys, id_column))).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        place = F.monotonically_increasing_id()  # range number above 33 bits of place in the range
        ranged = ranged.select(F.col(id_column).alias("id"), place.alias("place")).select("id", F.shiftright("place", 33).alias("range"), (F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rn"))
        ranges = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.col("rn") * F.col("id")).alias("places"), F.min_by("id", "rn").alias("first"), F.max_by("id", "rn").alias("last"))
        offset = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
        ranges = ranges.withColumn("positional", offset * F.col("ids") + F.col("places"))
        out = ranges.agg(F.min_by("first", "range").alias("first_id"), F.max_by("last", "range").alias("last_id"), F.sum("positional").alias("positional"))
        return out.select("first_id", "last_id", unsigned(F.col("positional")).alias("positional_sum_mod_2_64"))


def top_n(sales: DataFrame, n: int = 100) -> DataFrame:
    best = sales.groupBy("customer_id").agg(total("cents").alias("sum_price_cents")).orderBy(F.col("sum_price_cents").desc(), "customer_id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.col("sum_price_cents").desc(), "customer_id")).cast("bigint")
    return best.select(rank.alias("rank"), "customer_id", "sum_price_cents")


def distinct_count(sales: DataFrame) -> DataFrame:
    """Exact counts, each by a distinct of its own: one aggregate with three would make three rows of every row. A pair counts with a NULL too."""
    counts = [sales.select("customer_id").where("customer_id is not null").distinct(), sales.select("product_id").where("product_id is not null").distinct(), sales.select("store_id", "transaction_date").distinct()]
    one, two, three = (c.agg(F.count("*").alias(n)) for c, n in zip(counts, ("distinct_customers", "distinct_products", "distinct_store_days")))
    return one.join(F.broadcast(two)).join(F.broadcast(three))


def distinct_count_approx(sales: DataFrame, rsd: float = 0.01) -> DataFrame:
    pair = F.xxhash64("store_id", "transaction_date")
    return sales.agg(*[F.approx_count_distinct(c, rsd).alias(n) for c, n in (("customer_id", "distinct_customers"), ("product_id", "distinct_products"), (pair, "distinct_store_days"))])


def running_sum(sales: DataFrame) -> DataFrame:
    """Running cents of each customer by (timestamp, id), one row for each sale."""
    return _running(sales).select("customer_id", "transaction_id", "running_cents")


def _running(sales: DataFrame) -> DataFrame:
    """Running cents of each customer by (timestamp, id), and by cents where both repeat.

    A customer's days are summed first; a row's value is the total of the days before and the sum within its day, so the
    rows of a customer with a third of all sales are dealt by day and not sorted in one task.
    """
    rows = sales.select("customer_id", "transaction_id", "transaction_timestamp", "cents", F.col("transaction_timestamp").cast("date").alias("day"))
    days = rows.groupBy("customer_id", "day").agg(total("cents").alias("of_day"))
    before = F.sum("of_day").over(Window.partitionBy("customer_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(F.col("customer_id").alias("c"), F.col("day").alias("d"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("cents").over(Window.partitionBy("customer_id", "day").orderBy("transaction_timestamp", "transaction_id", "cents").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("within", within).join(days, F.col("customer_id").eqNullSafe(F.col("c")) & F.col("day").eqNullSafe(F.col("d")))
    # where a day has only NULLs so far the value is that of the days before
    return rows.select("customer_id", "transaction_id", "cents", (F.col("before") + F.coalesce("within", F.lit(0))).cast("bigint").alias("running_cents"))


def window_running_sum(sales: DataFrame) -> DataFrame:
    """Each customer's last running value, and the sum of all its running values modulo 2**64."""
    with wrapping(sales.sparkSession):
        # the last running value is that of all rows, also where the last (timestamp, id) repeats
        out = _running(sales).groupBy("customer_id").agg(F.coalesce(total("cents"), F.lit(0)).alias("last_running_cents"), F.sum("running_cents").alias("wrapped"))
        return out.select("customer_id", "last_running_cents", unsigned(F.col("wrapped")).alias("sum_running_mod_2_64"))


def summarise_columns(sales: DataFrame) -> DataFrame:
    """Sums over all thirteen columns; with a CSV frame, the parse is the work."""
    us = micros(F.col("transaction_timestamp"))
    million = F.lit(1_000_000).cast("bigint")
    sums = {f"sum_{c}": total(c) for c in ("transaction_id", "customer_id", "product_id", "store_id", "quantity")}
    sums |= {"nulls_quantity": F.count_if(F.col("quantity").isNull()), "sum_price_cents": total("cents"), "sum_discount_e6": total(millionths(F.col("discount"))), "sum_tax_e6": total(millionths(F.col("tax")))}
    sums |= {"sum_country_bytes": total(F.octet_length("country")), "nulls_country": F.count_if(F.col("country").isNull()), "sum_category_bytes": total(F.octet_length("category")), "sum_date_days": total(F.unix_date("transaction_date"))}
    sums |= {"sum_ts_seconds": total(F.call_function("div", us - F.pmod(us, million), million)), "sum_ts_micros_frac": total(F.pmod(us, million)), "count_returned": F.count_if("is_returned")}
    return sales.agg(F.count("*").alias("rows"), *[v.alias(k) for k, v in sums.items()])


def null_handling(sales: DataFrame) -> DataFrame:
    quantity, country = F.col("quantity"), F.col("country")
    return sales.agg(F.count_if(quantity.isNull()).alias("null_quantity"), F.count_if(country.isNull()).alias("null_country"), total(F.coalesce(quantity, F.lit(1))).alias("sum_quantity_or_1"), F.count_if(country.isNotNull() & (country != "")).alias("count_country_nonempty"), F.count_distinct(country).alias("distinct_country"))


def decimal_arithmetic(sales: DataFrame) -> DataFrame:
    """Exact sum of cents; the compensated sum is the exact decimal sum as a double, the naive one a sum of doubles."""
    out = sales.agg(total("cents").alias("exact_sum_cents"), F.sum(F.col("cents") / F.lit(100.0)).alias("naive_sum"))
    exact = F.col("exact_sum_cents")
    return out.select(exact, money_text(exact).alias("exact_sum_decimal"), "naive_sum", (exact.cast("decimal(38,0)") / 100).cast("double").alias("kahan_sum"))


def type_conversion_roundtrip(sales: DataFrame) -> DataFrame:
    k = F.col("transaction_id") * F.lit(4294967311).cast("bigint") + F.col("customer_id")
    c, us, thousand = F.col("cents"), micros(F.col("transaction_timestamp")), F.lit(1000).cast("bigint")
    day = F.col("transaction_date")
    ymd = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    return sales.agg(
        F.count_if(k.cast("double").cast("bigint") != k).alias("lossy_int64_float64"),
        F.count_if((c / F.lit(100.0) * F.lit(100.0)).cast("bigint") != c).alias("lossy_decimal_float64"),
        F.count_if(F.pmod(us, thousand) != 0).alias("lossy_ts_millis"),
        total(ymd).alias("sum_yyyymmdd"),
    )
