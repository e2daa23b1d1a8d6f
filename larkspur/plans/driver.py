"""The operations over the driver's star-schema tables, and the same in SQL.

lineitem joined to its dimensions is the sales frame. Keys that the operations read are taken from there; NULLs are made
by nullif, since the tables hold none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.digest import column_digests, table_digest
from larkspur.operators import events as E
from larkspur.operators import files as IO
from larkspur.operators import sales as S
from larkspur.sources import files
from larkspur.sources.generate import GENERATORS, Scale
from larkspur.storage import table_path

HOT_SEGMENT = "BUILDING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, customer: bool = False, country: bool = False, category: bool = False, joined: bool = True) -> DataFrame:
    """The sales frame. Lines without an order, customer, nation or part are left out; columns come only from where they are asked for.

    joined: False for the lines as they are.
    """
    item = table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate").cast("timestamp_ntz")
    frame = {
        "transaction_id": F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        "order_id": F.col("l_orderkey"),
        "line": F.col("l_linenumber"),
        "product_id": F.col("l_partkey"),
        "store_id": F.col("l_suppkey"),
        "quantity": F.nullif(F.col("l_quantity").cast("int"), F.lit(13)),
        "cents": F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        "discount": F.col("l_discount"),
        "tax": F.col("l_tax"),
        "transaction_date": ts.cast("date"),
        "transaction_timestamp": ts,
        "is_returned": F.col("l_returnflag") == "R",
    }
    if joined:
        # orders with their customer and country once, before the many lines meet them
        places = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(S.small(places), F.col("o_custkey") == F.col("c_custkey"))
        orders = orders.select("o_orderkey", *(["o_custkey"] if customer else []), *(["n_name"] if country else []))
        item = item.join(S.small(orders), F.col("l_orderkey") == F.col("o_orderkey"), "inner" if customer or country else "left_semi")
        parts = table(spark, sf_dir, "part").select("p_partkey", *(["p_type"] if category else []))
        item = item.join(S.small(parts), F.col("l_partkey") == F.col("p_partkey"), "inner" if category else "left_semi")
        frame |= {"customer_id": F.col("o_custkey")} if customer else {}
        frame |= {"country": F.nullif(F.col("n_name"), F.lit("NATION_3"))} if country else {}
        frame |= {"category": F.col("p_type")} if category else {}
    return item.select(*[v.alias(k) for k, v in frame.items()])


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir, customer=True, country=True, category=True)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_COPIES: dict[tuple[str, str, str], str] = {}


def copy_of(spark: SparkSession, sf_dir: str, form: str) -> str:
    """The sales frame as files, the input of the operations that read files: written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, form)
    if key not in _COPIES:
        path = table_path(spark, form)
        (files.write_csv if form == "csv" else files.write_parquet)(IO.published(every(spark, sf_dir)), path)
        _COPIES[key] = path
    return _COPIES[key]


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.star_join_aggregate(sales(spark, sf_dir, customer=True), customers(spark, sf_dir), products(spark, sf_dir), HOT_SEGMENT)


def sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sort(sales(spark, sf_dir, joined=False), ("transaction_timestamp", "order_id", "line", "product_id", "store_id"), "order_id")


def decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.decimal_arithmetic(sales(spark, sf_dir))
    return out.select("exact_sum_cents", "exact_sum_decimal", F.round("naive_sum", 2).alias("naive_sum"), F.round("kahan_sum", 2).alias("kahan_sum"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.string_ops(table(spark, sf_dir, "orders"), "o_orderpriority", "HIGH", "^([0-9]+)")


def generated(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Column digests of a generated table of 10,000 sales: the data and the digest in one row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        digests = column_digests(GENERATORS[name](spark, Scale(10_000)))
        rows = [(c, f"{s:016x}", n) for c, (s, n) in digests.items()] + [("*", table_digest(digests), 0)]
        return spark.createDataFrame(rows, "column_name string, digest string, nulls bigint")

    return run


def joins(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Customers against their orders above a price, by each join kind."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        dear = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")
        joined = people.join(dear, F.col("c_custkey") == F.col("o_custkey"), kind)
        return joined.groupBy("c_mktsegment").agg(F.count("*").alias("count_rows"), S.total("c_custkey").alias("sum_keys"))

    return run


def set_operation(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Customers in credit with buyers; exceptAll the other way round, where repeated orders are left over."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
        people = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
        return buyers.exceptAll(people) if kind == "exceptAll" else getattr(people, kind)(buyers).distinct()

    return run


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by date: rank, dense rank, and the prices of the neighbours."""
    at = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    by_day = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    price = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(by_day).cast("bigint").alias("day_rank"), F.dense_rank().over(by_day).cast("bigint").alias("day_dense_rank"), F.lag(price).over(at).alias("price_before"), F.lead(price).over(at).alias("price_after"))


def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view, a common table expression and a scalar subquery in Spark's SQL."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("larkspur_orders")
    return spark.sql("""
        with big as (select o_custkey, count(*) as n from larkspur_orders where o_totalprice > (select avg(o_totalprice) from larkspur_orders) group by o_custkey)
        select n as orders_above_average, count(*) as count_customers from big group by n""")


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the latest earlier or simultaneous purchase of the same user: an as-of join as one window over both sides' union."""
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    bought = rows.where("event_type = 'purchase'").select("user_id", "ts", F.lit(0).alias("side"), F.col("event_id").alias("purchase"), F.lit(None).cast("bigint").alias("event_id"))
    both = bought.union(rows.select("user_id", "ts", F.lit(1), F.lit(None).cast("bigint"), "event_id"))
    last = F.last("purchase", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "side", "purchase").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("purchase_id", last).where("side = 1").select("event_id", "purchase_id")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and maps: the distinct statuses and the counts by status of each customer's orders."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    held = per.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))).alias("entries")).withColumn("counts", F.map_from_entries("entries"))
    return held.select("o_custkey", F.array_join(F.map_keys("counts"), ",").alias("statuses"), F.element_at("entries", 1)["n"].alias("first_count"), F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("count_orders"))


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("event_id") % 700).alias("event_id"), "ts", F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_id"), "user_id")
    return E.latest_by_id(rows)


def of_generated_events(step: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: step(GENERATORS["events_log"](spark, Scale(10_000)))


def grouping(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grouped = getattr(table(spark, sf_dir, "lineitem"), kind)("l_returnflag", "l_linestatus")
        return grouped.agg(F.count("*").alias("count_rows"), S.total(F.col("l_quantity").cast("bigint")).alias("sum_quantity"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "OP01_scan_aggregate": lambda s, d: S.scan_aggregate(sales(s, d)),
    "OP02_filter_project": lambda s, d: S.filter_project(sales(s, d, customer=True, country=True), ("NATION_1", "NATION_2", "NATION_7"), 0.05),
    "OP03_groupby_low_cardinality": lambda s, d: S.groupby_low_cardinality(sales(s, d, country=True)),
    "OP04_groupby_high_cardinality": lambda s, d: S.groupby_high_cardinality(sales(s, d, customer=True)),
    "OP05_groupby_multi_key": lambda s, d: S.groupby_multi_key(sales(s, d, country=True, category=True)),
    "OP06_hash_join_aggregate": lambda s, d: S.hash_join_aggregate(sales(s, d, customer=True), customers(s, d)),
    "OP07_star_join_aggregate": star,
    "OP08_sort": sort,
    "OP09_top_n": lambda s, d: S.top_n(sales(s, d, customer=True)),
    "OP10_distinct_count": lambda s, d: S.distinct_count(sales(s, d, customer=True)),
    "OP10_distinct_count_approx": lambda s, d: S.distinct_count_approx(sales(s, d, customer=True)),
    "OP11_window_running_sum": lambda s, d: S.window_running_sum(sales(s, d, customer=True)),
    "OP11_window_running_sum_events": lambda s, d: E.running_value(events(s, d)),
    "OP12_deduplicate": lambda s, d: E.deduplicate(events(s, d).select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], ["ts", "event_id"]),
    "OP12_deduplicate_by_event": repeated_events,
    "OP12_deduplicate_generated": of_generated_events(E.latest_by_id),
    "OP13_string_ops": strings,
    "OP13_payload_strings": of_generated_events(E.payload_strings),
    "OP14_payload_json": of_generated_events(E.payload_json),
    "OP14_json_extract": lambda s, d: E.json_extract(events(s, d), "event_type", "props", "$.k"),
    "OP15_parse_csv": lambda s, d: IO.parse_csv(s, copy_of(s, d, "csv")),
    "OP16_read_parquet_aggregate": lambda s, d: IO.read_parquet_aggregate(s, copy_of(s, d, "parquet")),
    "OP17_write_csv_parquet": lambda s, d: IO.write_csv_parquet(every(s, d)),
    "OP18_datetime_arithmetic": lambda s, d: E.datetime_arithmetic(events(s, d), "ts"),
    "OP19_null_handling": lambda s, d: S.null_handling(sales(s, d, country=True)),
    "OP20_wide_numeric_scan": lambda s, d: E.wide_scan(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3),
    "OP21_decimal_arithmetic": decimals,
    "OP22_type_conversion_roundtrip": lambda s, d: S.type_conversion_roundtrip(sales(s, d, customer=True)),
    **{f"OP00_generated_{name}": generated(name) for name in GENERATORS},
    **{f"join_{kind}": joins(kind) for kind in ("inner", "left", "right", "full", "left_semi", "left_anti")},
    "join_as_of": as_of,
    "window_rank_lag_lead": ranked,
    "sql_view_cte_subquery": above_average,
    "array_map_functions": collections,
    **{f"set_{kind}": set_operation(kind) for kind in ("union", "intersect", "exceptAll")},
    **{f"grouping_{kind}": grouping(kind) for kind in ("rollup", "cube")},
}

SALES = """
    select l_orderkey * 8 + l_linenumber as transaction_id, o_custkey as customer_id, l_partkey as product_id, l_suppkey as store_id,
           nullif(cast(l_quantity as integer), 13) as quantity, cast(round(l_extendedprice * 100) as bigint) as cents, l_discount as discount, l_tax as tax,
           nullif(n_name, 'NATION_3') as country, p_type as category, cast(l_shipdate as date) as transaction_date, l_shipdate as transaction_timestamp,
           l_returnflag = 'R' as is_returned
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
         join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey"""

SUMMARY = """count(*) as rows, cast(sum(transaction_id) as bigint) as sum_transaction_id, cast(sum(customer_id) as bigint) as sum_customer_id,
    cast(sum(product_id) as bigint) as sum_product_id, cast(sum(store_id) as bigint) as sum_store_id, cast(sum(quantity) as bigint) as sum_quantity,
    count(*) filter (where quantity is null) as nulls_quantity, cast(sum(cents) as bigint) as sum_price_cents,
    cast(sum(cast(floor(discount * 1e6 + 0.5) as bigint)) as bigint) as sum_discount_e6, cast(sum(cast(floor(tax * 1e6 + 0.5) as bigint)) as bigint) as sum_tax_e6,
    cast(sum(strlen(country)) as bigint) as sum_country_bytes, count(*) filter (where country is null) as nulls_country, cast(sum(strlen(category)) as bigint) as sum_category_bytes,
    cast(sum(transaction_date - date '1970-01-01') as bigint) as sum_date_days, cast(sum(epoch_us(transaction_timestamp) // 1000000) as bigint) as sum_ts_seconds,
    cast(sum(epoch_us(transaction_timestamp) % 1000000) as bigint) as sum_ts_micros_frac, count(*) filter (where is_returned) as count_returned"""

SCAN = """count(*) as count_rows, count(quantity) as count_quantity, cast(sum(quantity) as bigint) as sum_quantity, cast(sum(cents) as bigint) as sum_price_cents,
    min(cents) as min_price_cents, max(cents) as max_price_cents, count(*) filter (where is_returned) as count_returned"""

JOINED = "select c_mktsegment, count(*) as count_rows, cast(sum(c_custkey) as bigint) as sum_keys from customer {join} group by c_mktsegment"
DEAR = "(select o_custkey from orders where o_totalprice > 200000)"
GROUPED = "select l_returnflag, l_linestatus, count(*) as count_rows, cast(sum(cast(trunc(l_quantity) as bigint)) as bigint) as sum_quantity from lineitem group by {kind}(l_returnflag, l_linestatus)"

ORACLE_SQL = {
    "OP01_scan_aggregate": f"with sales as ({SALES}) select {SCAN} from sales",
    "OP02_filter_project": f"with sales as ({SALES}) select transaction_id, customer_id, cents, country from sales where not is_returned and discount > 0.05 and country in ('NATION_1', 'NATION_2', 'NATION_7')",
    "OP03_groupby_low_cardinality": f"with sales as ({SALES}) select country, count(*) as count_rows, cast(sum(quantity) as bigint) as sum_quantity, cast(sum(cents) as bigint) as sum_price_cents from sales group by country",
    "OP04_groupby_high_cardinality": f"with sales as ({SALES}) select customer_id, count(*) as count_rows, cast(sum(cents) as bigint) as sum_price_cents from sales group by customer_id",
    "OP05_groupby_multi_key": f"with sales as ({SALES}) select country, category, cast(year(transaction_date) as bigint) as year, count(*) as count_rows, cast(sum(cents) as bigint) as sum_price_cents from sales group by 1, 2, 3",
    "OP06_hash_join_aggregate": f"with sales as ({SALES}) select c_mktsegment as segment, count(*) as count_rows, cast(sum(cents) as bigint) as sum_price_cents, cast(sum(quantity) as bigint) as sum_quantity from sales join customer on customer_id = c_custkey group by 1",
    "OP07_star_join_aggregate": f"with sales as ({SALES}) select p_brand as brand, count(*) as count_rows, cast(sum(cents) as bigint) as sum_price_cents from sales join customer on customer_id = c_custkey join part on product_id = p_partkey where c_mktsegment = '{HOT_SEGMENT}' group by 1",
    "OP08_sort": """with o as (select l_orderkey as id, row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from lineitem)
        select min_by(id, rn) as first_id, max_by(id, rn) as last_id, cast(sum(cast(rn as decimal(19,0)) * cast(id as decimal(19,0))) % 18446744073709551616::hugeint as decimal(20,0)) as positional_sum_mod_2_64 from o""",
    "OP09_top_n": f"with sales as ({SALES}), t as (select customer_id, cast(sum(cents) as bigint) as sum_price_cents from sales group by 1 order by 2 desc, 1 limit 100) select row_number() over (order by sum_price_cents desc, customer_id) as rank, customer_id, sum_price_cents from t",
    "OP10_distinct_count": f"with sales as ({SALES}) select count(distinct customer_id) as distinct_customers, count(distinct product_id) as distinct_products, (select count(*) from (select distinct store_id, transaction_date from sales)) as distinct_store_days from sales",
    "OP11_window_running_sum": f"""with sales as ({SALES}), r as (select customer_id, cast(sum(cents) over (partition by customer_id order by transaction_timestamp, transaction_id, cents rows between unbounded preceding and current row) as bigint) as running, cents from sales)
        select customer_id, cast(sum(cents) as bigint) as last_running_cents, cast(((sum(running::hugeint) % 18446744073709551616::hugeint) + 18446744073709551616::hugeint) % 18446744073709551616::hugeint as decimal(20,0)) as sum_running_mod_2_64 from r group by 1""",
    "OP11_window_running_sum_events": "select user_id, event_id, cast(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as bigint) as running_cents from events",
    "OP12_deduplicate": "select event_id, ts, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1",
    "OP12_deduplicate_by_event": "with e as (select event_id % 700 as event_id, ts, 's' || event_id as session_id, user_id from events) select * exclude (rn) from (select *, row_number() over (partition by event_id order by ts desc, session_id) as rn from e) where rn = 1",
    "OP13_string_ops": "select lower(o_orderpriority) as lowered, substring(o_orderpriority, 3, 4) as part, regexp_extract(o_orderpriority, '^([0-9]+)', 1) as extracted, count(*) filter (where contains(o_orderpriority, 'HIGH')) as n_contains, cast(sum(strlen(o_orderpriority)) as bigint) as sum_bytes, count(*) as count_rows from orders group by 1, 2, 3",
    "OP14_json_extract": "select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as sum_value, count(json_extract_string(props, '$.k')) as count_value, count(*) as count_rows from events group by 1",
    "OP15_parse_csv": f"with sales as ({SALES}) select {SUMMARY} from sales",
    "OP16_read_parquet_aggregate": f"with sales as ({SALES}) select {SCAN} from sales",
    "OP17_write_csv_parquet": f"with sales as ({SALES}), one as (select {SUMMARY} from sales) select one.*, form from one, (values ('csv'), ('parquet')) as f(form)",
    "OP18_datetime_arithmetic": """select (epoch_us(ts) // 3600000000) * 3600000000 as hour_us, cast(cast(ts as date) - date '1970-01-01' as bigint) as day, cast(cast(ts + interval 9 hour as date) - date '1970-01-01' as bigint) as local_day, count(*) as count_rows from events group by 1, 2, 3""",
    "OP19_null_handling": f"with sales as ({SALES}) select count(*) filter (where quantity is null) as null_quantity, count(*) filter (where country is null) as null_country, cast(sum(coalesce(quantity, 1)) as bigint) as sum_quantity_or_1, count(*) filter (where country is not null and country <> '') as count_country_nonempty, count(distinct country) as distinct_country from sales",
    "OP20_wide_numeric_scan": "select " + ", ".join(f"round(sum({c}), 3) as sum_{c}, round(stddev_pop({c}), 3) as stddev_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " from lineitem",
    "OP21_decimal_arithmetic": f"with sales as ({SALES}) select cast(sum(cents) as bigint) as exact_sum_cents, cast(sum(cents) // 100 as varchar) || '.' || lpad(cast(sum(cents) % 100 as varchar), 2, '0') as exact_sum_decimal, round(sum(cents / 100.0::double), 2) as naive_sum, round(fsum(cents / 100.0::double), 2) as kahan_sum from sales",
    "OP22_type_conversion_roundtrip": f"""with sales as ({SALES}) select count(*) filter (where cast(cast(transaction_id * 4294967311 + customer_id as double) as bigint) <> transaction_id * 4294967311 + customer_id) as lossy_int64_float64,
        count(*) filter (where cast(trunc(cast(cents as double) / 100.0::double * 100.0::double) as bigint) <> cents) as lossy_decimal_float64,
        count(*) filter (where epoch_us(transaction_timestamp) % 1000 <> 0) as lossy_ts_millis,
        cast(sum(year(transaction_date) * 10000 + month(transaction_date) * 100 + day(transaction_date)) as bigint) as sum_yyyymmdd from sales""",
    "join_inner": JOINED.format(join=f"join {DEAR} on c_custkey = o_custkey"),
    "join_left": JOINED.format(join=f"left join {DEAR} on c_custkey = o_custkey"),
    "join_right": JOINED.format(join=f"right join {DEAR} on c_custkey = o_custkey"),
    "join_full": JOINED.format(join=f"full join {DEAR} on c_custkey = o_custkey"),
    "join_as_of": "select e.event_id, (select max_by(p.event_id, {'ts': p.ts, 'id': p.event_id}) from events p where p.event_type = 'purchase' and p.user_id = e.user_id and p.ts <= e.ts) as purchase_id from events e",
    "window_rank_lag_lead": """select o_orderkey, rank() over d as day_rank, dense_rank() over d as day_dense_rank, lag(price) over w as price_before, lead(price) over w as price_after
        from (select *, cast(round(o_totalprice * 100) as bigint) as price from orders) window d as (partition by o_custkey order by o_orderdate), w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "sql_view_cte_subquery": "with big as (select o_custkey, count(*) as n from orders where o_totalprice > (select avg(o_totalprice) from orders) group by 1) select n as orders_above_average, count(*) as count_customers from big group by 1",
    "array_map_functions": "with per as (select o_custkey, o_orderstatus as s, count(*) as n from orders group by 1, 2) select o_custkey, string_agg(s, ',' order by s) as statuses, min_by(n, s) as first_count, cast(sum(n) as bigint) as count_orders from per group by 1",
    "join_left_semi": JOINED.format(join=f"where c_custkey in {DEAR}"),
    "join_left_anti": JOINED.format(join=f"where c_custkey not in {DEAR}"),
    "set_union": "select o_custkey as k from orders union select c_custkey from customer where c_acctbal > 0",
    "set_intersect": "select c_custkey as k from customer where c_acctbal > 0 intersect select o_custkey from orders",
    "set_exceptAll": "select o_custkey as k from orders except all select c_custkey from customer where c_acctbal > 0",
    "grouping_rollup": GROUPED.format(kind="rollup"),
    "grouping_cube": GROUPED.format(kind="cube"),
}
