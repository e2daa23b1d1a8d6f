"""The five generated tables as functions of the row number.

Every value depends on (seed, table, stream, row) alone, so any partitioning of spark.range gives the same rows and the
tables need no shuffle at any size.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalar import from_micros, price
from larkspur.functions.wrapping import Streams, skewed, unit, unsigned_mod, wrapping
from larkspur.sources import vocabulary as V

# Seed, table numbers, sizes and limits of the generated tables.
SEED = 0x5EED1B20
TABLES = {"sales_fact": 1, "dim_customer": 2, "dim_product": 3, "events_log": 4, "wide_numeric": 5}
STORES, EDGE_EVERY, WIDE_LIMIT = 5000, 1000, 100_000_000
CHUNK_ROWS = 1_000_000
DAY_US = 86_400_000_000
LABELS = {"k": 10**3, "m": 10**6, "b": 10**9}

# Published bytes a row: Arrow, Parquet, CSV.
ROW_BYTES = {"sales_fact": (104.6, 37.0, 110.0), "dim_customer": (97.2, 15.2, 83.7), "dim_product": (106.2, 11.6, 104.2), "events_log": (391.2, 61.5, 409.6), "wide_numeric": (968.0, 1057.6, 2130.1)}


def rows_of(label: str | int) -> int:
    """1k, 10m, 1b or any integer."""
    text = str(label).strip().lower().replace("_", "")
    n = int(text[:-1]) * LABELS[text[-1]] if text[-1:] in LABELS else int(text)
    if n < 1:
        raise ValueError(f"a scale is at least one row, not {label!r}")
    return n


def label_of(n: int) -> str:
    for suffix in ("b", "m", "k"):
        if n % LABELS[suffix] == 0:
            return f"{n // LABELS[suffix]}{suffix}"
    return str(n)


@dataclass(frozen=True)
class Scale:
    """Rows of the fact tables; wide_numeric stops at WIDE_LIMIT rows unless large_wide is set."""

    rows: int
    large_wide: bool = False

    @property
    def customers(self) -> int:
        return min(max(self.rows // 10, 1), 50_000_000)

    @property
    def products(self) -> int:
        return min(max(self.rows // 100, 10), 1_000_000)

    @property
    def users(self) -> int:
        return max(self.rows // 100, 10)

    def table_rows(self, table: str) -> int:
        return {"dim_customer": self.customers, "dim_product": self.products, "wide_numeric": self.rows if self.large_wide else min(self.rows, WIDE_LIMIT)}.get(table, self.rows)


def estimated_bytes(table: str, scale: Scale, form: str = "parquet") -> int:
    return int(scale.table_rows(table) * ROW_BYTES[table][("arrow", "parquet", "csv").index(form)])


def refuse_beyond(tables: list[str], scale: Scale, form: str, budget_gb: float) -> None:
    """Raises if the estimate with a tenth on top exceeds the budget."""
    need = 1.1 * sum(estimated_bytes(t, scale, form) for t in tables) / 1e9
    if need > budget_gb:
        raise ValueError(f"{label_of(scale.rows)} as {form} needs about {need:.1f} GB; the budget is {budget_gb:g} GB")


def days(year: int, month: int, day: int) -> int:
    return (datetime.date(year, month, day) - datetime.date(1970, 1, 1)).days


def entry(words: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), index.cast("int") + 1)


def numbered(prefix: str, index: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(index.cast("string"), width, "0"))


def _rows(spark: SparkSession, n: int, first: int, count: int | None, chunk_rows: int) -> DataFrame:
    last = n if count is None else min(n, first + count)
    parts = max(1, -(-(last - first) // chunk_rows))
    cores = spark.sparkContext.defaultParallelism
    return spark.range(first, last, 1, numPartitions=max(parts, min(cores, max(1, (last - first) // 10_000))))


def _drawn(rows: DataFrame, streams: Streams, numbers: range | list[int]) -> DataFrame:
    return rows.select("id", *[streams.value(c, F.col("id")).alias(f"r{c}") for c in numbers])


def _mod(stream: int, n: int) -> Column:
    return unsigned_mod(F.col(f"r{stream}"), n)


def _unit(stream: int) -> Column:
    return unit(F.col(f"r{stream}"))


def sales_fact(spark: SparkSession, scale: Scale, seed: int = SEED, first: int = 0, count: int | None = None, price_as: str = "decimal", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """price_as: decimal, float64 or cents."""
    with wrapping(spark):
        d = _drawn(_rows(spark, scale.rows, first, count, chunk_rows), Streams(seed, TABLES["sales_fact"]), range(17))
        base = d.select(
            "id",
            (skewed(_unit(0), scale.customers, 3) + 1).alias("customer_id"),
            (_mod(1, scale.products) + 1).alias("product_id"),
            (_mod(2, STORES) + 1).cast("int").alias("store_id"),
            (_mod(3, 20) + 1).alias("base_quantity"),
            ((_unit(4) * _unit(5) * _unit(6) * F.lit(999900.0)).cast("bigint") + 99).alias("cents"),
            (F.when(_mod(7, 100) < 30, 0).otherwise(_mod(8, 51)) / F.lit(100.0)).alias("discount"),
            skewed(_unit(9), len(V.COUNTRIES), 2).alias("place"),
            skewed(_unit(10), 200, 2).alias("kind"),
            (_mod(11, 4018) + days(2015, 1, 1)).alias("day"),
            (_mod(12, 86400) * 1_000_000 + _mod(13, 1_000_000)).alias("time"),
            (_mod(14, 100) < 5).alias("is_returned"),
            (_mod(15, 1000) == 0).alias("no_quantity"),
            (_mod(16, 10000) == 0).alias("no_country"),
            F.when(F.col("id") % EDGE_EVERY == EDGE_EVERY - 1, F.expr(f"id div {EDGE_EVERY}") % 8).otherwise(-1).alias("edge"),
        )
        edge = F.col("edge")
        rate = F.element_at(F.array(*map(F.lit, V.TAX_RATES)), F.col("place").cast("int") + 1)
        shown = {"decimal": price(F.col("cents")), "float64": F.col("cents") / F.lit(100.0), "cents": F.col("cents")}[price_as]
        time = F.when(edge == 6, DAY_US - 1).when(edge == 7, 0).otherwise(F.col("time"))
        return base.select(
            (F.col("id") + 1).alias("transaction_id"),
            "customer_id",
            "product_id",
            "store_id",
            F.when(edge == 0, 2147483647).when(edge == 1, -2147483648).when(~F.col("no_quantity"), F.col("base_quantity").cast("int")).alias("quantity"),
            shown.alias("unit_price"),
            "discount",
            ((F.col("cents") * F.col("base_quantity") * rate).cast("double") / F.lit(1e6)).alias("tax"),
            F.when(edge == 2, V.EDGE_COUNTRIES[0]).when(edge == 3, V.EDGE_COUNTRIES[1]).when(~F.col("no_country"), entry(V.COUNTRIES, F.col("place"))).alias("country"),
            F.when(edge == 4, V.EDGE_CATEGORIES[0]).when(edge == 5, V.EDGE_CATEGORIES[1]).otherwise(numbered("category_", F.col("kind"), 3)).alias("category"),
            F.date_from_unix_date(F.col("day").cast("int")).alias("transaction_date"),
            from_micros(F.col("day") * DAY_US + time).alias("transaction_timestamp"),
            "is_returned",
        )


def dim_customer(spark: SparkSession, scale: Scale, seed: int = SEED, first: int = 0, count: int | None = None, price_as: str = "decimal", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    with wrapping(spark):
        d = _drawn(_rows(spark, scale.customers, first, count, chunk_rows), Streams(seed, TABLES["dim_customer"]), range(4))
        number = (F.col("id") + 1).cast("string")
        worth = _mod(3, 100_000_000)
        return d.select(
            (F.col("id") + 1).alias("customer_id"),
            F.concat(F.lit("Customer "), number).alias("name"),
            F.concat(F.lit("user"), number, F.lit("@example.com")).alias("email"),
            F.date_from_unix_date((_mod(0, 5000) + days(2010, 1, 1)).cast("int")).alias("signup_date"),
            entry(V.SEGMENTS, _mod(1, len(V.SEGMENTS))).alias("segment"),
            entry(V.COUNTRIES, skewed(_unit(2), len(V.COUNTRIES), 2)).alias("country"),
            {"decimal": price(worth), "float64": worth / F.lit(100.0), "cents": worth}[price_as].alias("lifetime_value"),
        )


def dim_product(spark: SparkSession, scale: Scale, seed: int = SEED, first: int = 0, count: int | None = None, chunk_rows: int = CHUNK_ROWS, **_) -> DataFrame:
    with wrapping(spark):
        streams = Streams(seed, TABLES["dim_product"])
        d = _rows(spark, scale.products, first, count, chunk_rows)
        tags = [numbered("tag_", unsigned_mod(streams.value(5, F.col("id") * 4 + j), 32), 2) for j in range(4)]
        d = d.select("id", F.array(*tags).alias("tags"), *[streams.value(c, F.col("id")).alias(f"r{c}") for c in (0, 1, 2, 3, 4, 6, 7)])
        return d.select(
            (F.col("id") + 1).alias("product_id"),
            numbered("category_", skewed(_unit(0), 200, 2), 3).alias("category"),
            numbered("brand_", _mod(1, 500), 3).alias("brand"),
            F.when(_mod(2, 10) != 0, (_mod(3, 50000) + 10).cast("int")).alias("weight_grams"),
            F.slice("tags", F.lit(1), (_mod(4, 4) + 1).cast("int")).alias("tags"),
            F.create_map(F.lit("color"), entry(V.COLORS, _mod(6, len(V.COLORS))), F.lit("size"), entry(V.SIZES, _mod(7, len(V.SIZES)))).alias("attributes"),
        )


def events_log(spark: SparkSession, scale: Scale, seed: int = SEED, first: int = 0, count: int | None = None, chunk_rows: int = CHUNK_ROWS, **_) -> DataFrame:
    with wrapping(spark):
        d = _drawn(_rows(spark, scale.rows, first, count, chunk_rows), Streams(seed, TABLES["events_log"]), range(14))
        i = F.col("id")
        earlier = unsigned_mod(F.col("r1"), F.greatest(i, F.lit(1).cast("bigint"))) + 1
        again = (i > 0) & (_mod(0, 100) == 0)
        user, kind = _mod(3, scale.users) + 1, entry(V.EVENT_TYPES, _mod(4, len(V.EVENT_TYPES)))
        note = F.substring(F.lit(V.PADDING * 45), F.lit(1), _mod(6, 451).cast("int"))
        digits = F.concat(*[F.lower(F.lpad(F.hex(f"r{c}"), 16, "0")) for c in (7, 8)])
        parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        octets = [F.shiftrightunsigned("r9", s).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for s in (24, 16, 8, 0)]
        size = (_unit(10) * _unit(11) * _unit(12) * _unit(13) * F.lit(1e9)).cast("bigint") + 1
        return d.select(
            F.when(again, earlier).otherwise(i + 1).alias("event_id"),
            from_micros(i * 1000 + _mod(2, 60_000_000) + (days(2025, 1, 1) * DAY_US - 30_000_000)).alias("ts"),
            user.alias("user_id"),
            kind.alias("event_type"),
            F.concat(F.lit('{"user":{"id":'), user.cast("string"), F.lit('},"action":"'), kind, F.lit('","amount":'), _mod(5, 100000).cast("string"), F.lit(',"note":"'), note, F.lit('"}')).alias("payload_json"),
            F.concat_ws("-", *parts).alias("session_id"),
            F.concat_ws(".", *octets).alias("ip"),
            size.alias("bytes"),
        )


def wide_numeric(spark: SparkSession, scale: Scale, seed: int = SEED, first: int = 0, count: int | None = None, chunk_rows: int = 250_000, **_) -> DataFrame:
    with wrapping(spark):
        streams, i = Streams(seed, TABLES["wide_numeric"]), F.col("id")
        d = _rows(spark, scale.table_rows("wide_numeric"), first, count, chunk_rows)
        floats = [unit(streams.value(c, i)).alias(f"f{c:03d}") for c in range(100)]
        ints = [unsigned_mod(streams.value(100 + c, i), 1_000_000_007).alias(f"i{c:02d}") for c in range(20)]
        return d.select((i + 1).alias("id"), *floats, *ints)


GENERATORS = {f.__name__: f for f in (sales_fact, dim_customer, dim_product, events_log, wide_numeric)}
