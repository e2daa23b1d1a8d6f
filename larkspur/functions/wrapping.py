"""Unsigned 64-bit arithmetic on bigint columns, and the counter-based random streams built on it.

bigint multiplication and sums that wrap are exactly arithmetic modulo 2**64. Spark fixes the overflow behaviour of an
expression when a plan is analysed, so wrapped expressions must be selected inside `wrapping(spark)`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The constants of the splitmix64 finaliser and its increment.
GOLDEN = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFTS = (30, 27, 31)

MASK = (1 << 64) - 1


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Plans analysed inside overflow silently; the setting is put back afterwards."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def long(x: int) -> Column:
    return F.lit(signed(x)).cast("bigint")


def mix(x: int) -> int:
    """The finaliser on a Python integer."""
    x &= MASK
    for shift, factor in zip(SHIFTS, (*MULTIPLIERS, 1)):
        x = (x ^ (x >> shift)) * factor & MASK
    return x


def mix_column(x: Column) -> Column:
    """The finaliser on a bigint column; needs wrapping()."""
    for shift, factor in zip(SHIFTS, (*MULTIPLIERS, None)):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
        if factor is not None:
            x = x * long(factor)
    return x


class Streams:
    """Random streams of one table: the value of stream c at counter i depends on (seed, table, c, i) alone."""

    def __init__(self, seed: int, table: int):
        self.seed, self.table = seed, table

    def key(self, stream: int) -> int:
        return mix(self.seed ^ (((self.table << 16) | stream) * GOLDEN))

    def value(self, stream: int, counter: Column) -> Column:
        return mix_column(counter * long(GOLDEN) + long(self.key(stream)))


def unsigned_mod(x: Column, n: int | Column) -> Column:
    """x mod n with x as an unsigned number; 0 < n < 2**62. Halving keeps every step within 63 bits."""
    n = F.lit(n).cast("bigint") if isinstance(n, int) else n
    half = F.shiftrightunsigned(x, 1) % n
    return (half * 2 + x.bitwiseAND(long(1))) % n


def unit(x: Column) -> Column:
    """The upper 53 bits as a double in [0, 1)."""
    return F.shiftrightunsigned(x, 11).cast("double") * F.lit(2.0**-53)


def skewed(u: Column, n: int, power: int) -> Column:
    """An index below n that favours small ones: trunc(n * u ** power), products from left to right."""
    v = u
    for _ in range(power - 1):
        v = v * u
    return F.least((F.lit(float(n)) * v).cast("bigint"), long(n - 1))


def unsigned(x: Column) -> Column:
    """A bigint's bits as a decimal(20,0) from 0 to 2**64 - 1."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(Decimal(1 << 64))).otherwise(d).cast("decimal(20,0)")
