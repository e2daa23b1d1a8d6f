import random

from pyspark.sql import functions as F

from larkspur.functions import wrapping as w

NUMBERS = [0, 1, -1, 2**63 - 1, -(2**63), *[random.Random(7).randrange(-(2**63), 2**63) for _ in range(200)]]


def rows(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(NUMBERS)], "i bigint, x bigint")


def test_mix_and_unit_match_python_integers(spark):
    with w.wrapping(spark):
        df = rows(spark).select("i", w.mix_column(F.col("x")).alias("m"), w.unit(F.col("x")).alias("u"), w.unsigned(F.col("x")).alias("n"))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    for r in df.collect():
        x = NUMBERS[r.i] & w.MASK
        assert r.m & w.MASK == w.mix(x)
        assert r.u == (x >> 11) * 2.0**-53
        assert int(r.n) == x


def test_unsigned_mod(spark):
    for n in (1, 2, 97, 5000, 1_000_000_007, 2**40 + 1):
        with w.wrapping(spark):
            df = rows(spark).select("i", w.unsigned_mod(F.col("x"), n).alias("m"))
        assert [r.m for r in df.orderBy("i").collect()] == [(x & w.MASK) % n for x in NUMBERS]


def test_skew_stays_below_n(spark):
    with w.wrapping(spark):
        df = spark.createDataFrame([(0.0,), (0.5,), (1.0 - 2**-53,)], "u double").select(w.skewed(F.col("u"), 40, 2).alias("k"))
    assert [r.k for r in df.collect()] == [0, 10, 39]
