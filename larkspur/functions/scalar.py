"""Money, time and text expressions of the operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(price: Column) -> Column:
    """decimal(18,2) as bigint cents, exactly."""
    return (price * 100).cast("bigint")


def price(cents_: Column) -> Column:
    return (cents_.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_div(x: Column, n: int) -> Column:
    """Floor division of bigint: -1 by 1000 is -1 (div alone would truncate to 0)."""
    n_ = F.lit(n).cast("bigint")
    return F.call_function("div", x - F.pmod(x, n_), n_)


def money_text(c: Column) -> Column:
    """cents as <int>.<two digits>, both parts by floor."""
    return F.concat(floor_div(c, 100).cast("string"), F.lit("."), F.lpad(F.pmod(c, F.lit(100).cast("bigint")).cast("string"), 2, "0"))


def millionths(x: Column) -> Column:
    """A double as rounded millionths."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("bigint")
