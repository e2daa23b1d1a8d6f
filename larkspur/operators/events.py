"""Operations over events and wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import floor_div, micros
from larkspur.operators.sales import total


def deduplicate(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by order, as one aggregation: copies meet before the shuffle, no key is sorted."""
    rest = [c for c in events.columns if c not in (*keys, *order)]
    last = events.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}") for c in events.columns])


def string_ops(df: DataFrame, text: str, needle: str, pattern: str) -> DataFrame:
    t = F.col(text)
    return df.groupBy(F.lower(t).alias("lowered"), F.substring(t, 3, 4).alias("part"), F.regexp_extract(t, pattern, 1).alias("extracted")).agg(F.count_if(t.contains(needle)).alias("n_contains"), total(F.octet_length(t)).alias("sum_bytes"), F.count("*").alias("count_rows"))


def json_extract(df: DataFrame, key: Column | str, json: str, path: str) -> DataFrame:
    value = F.get_json_object(F.col(json), path).cast("bigint")
    return df.groupBy(key).agg(total(value).alias("sum_value"), F.count(value).alias("count_value"), F.count("*").alias("count_rows"))


def datetime_arithmetic(df: DataFrame, ts: str, zone: str = "Asia/Tokyo") -> DataFrame:
    """Rows by hour and day in UTC, and by day in one other zone."""
    us = micros(F.col(ts))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    hour = (floor_div(us, 3_600_000_000) * 3_600_000_000).alias("hour_us")
    return df.groupBy(hour, F.unix_date(F.col(ts).cast("date")).cast("bigint").alias("day"), F.unix_date(local.cast("date")).cast("bigint").alias("local_day")).agg(F.count("*").alias("count_rows"))


def wide_scan(df: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    def shown(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c

    return df.agg(*[shown(F.sum(c)).alias(f"sum_{c}") for c in columns], *[shown(F.stddev_pop(c)).alias(f"stddev_{c}") for c in columns])


def running_value(events: DataFrame) -> DataFrame:
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = F.round(F.col("value") * 100).cast("bigint")
    return events.select("user_id", "event_id", F.sum(c).over(frame).cast("bigint").alias("running_cents"))


def latest_by_id(events: DataFrame) -> DataFrame:
    """The latest row of each event_id; of equally late ones that with the smallest session_id."""
    rest = [c for c in events.columns if c not in ("event_id", "ts", "session_id")]
    latest = events.groupBy("event_id").agg(F.max("ts").alias("ts"))
    rows = events.alias("e").join(latest.alias("l"), "event_id").where(F.col("e.ts").eqNullSafe(F.col("l.ts"))).select("event_id", "e.ts", "e.session_id", *[f"e.{c}" for c in rest])
    return rows.groupBy("event_id").agg(F.min(F.struct("session_id", "ts", *rest)).alias("one")).select(*[F.col(c) if c == "event_id" else F.col(f"one.{c}") for c in events.columns])


def payload_strings(events: DataFrame) -> DataFrame:
    """By event_type: payloads that hold the lower-cased type, bytes of a lower-cased part, digits of the first number."""
    low = F.lower("payload_json")
    digits = F.regexp_extract("payload_json", "([0-9]+)", 1)
    return events.groupBy("event_type").agg(F.count_if(low.contains(F.lower("event_type"))).alias("n_contains"), total(F.octet_length(F.substring(low, 3, 40))).alias("sum_part_bytes"), total(F.char_length(digits)).alias("sum_digits"), F.count("*").alias("count_rows"))


def payload_json(events: DataFrame) -> DataFrame:
    """By event_type: sums of $.user.id and $.amount."""
    user, amount = (F.get_json_object("payload_json", p).cast("bigint") for p in ("$.user.id", "$.amount"))
    return events.groupBy("event_type").agg(total(user).alias("sum_user_id"), total(amount).alias("sum_amount"), F.count("*").alias("count_rows"))
