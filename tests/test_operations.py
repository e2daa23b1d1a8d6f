import datetime

from pyspark.sql import functions as F

from larkspur.functions.scalar import floor_div, from_micros, micros, money_text
from larkspur.operators import events as E
from larkspur.operators import sales as S


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_join_keeps_null_segments_and_drops_strangers(spark):
    people = spark.createDataFrame([(1, ""), (2, "é"), (3, None)], "customer_id bigint, segment string")
    sales = spark.createDataFrame([(1, 101, None), (2, -201, 0), (3, 300, None), (99, 999, 5), (1, 102, None), (2, 202, -3)], "customer_id bigint, cents bigint, quantity int")
    assert collected(S.hash_join_aggregate(sales, people)) == sorted([("", 2, 203, None), ("é", 2, 1, -3), (None, 1, 300, None)], key=str)


def test_star_join(spark):
    people = spark.createDataFrame([(1, "enterprise"), (2, "consumer")], "customer_id bigint, segment string")
    goods = spark.createDataFrame([(1, ""), (2, "品牌"), (3, None)], "product_id bigint, brand string")
    sales = spark.createDataFrame([(1, 1, 101), (2, 2, 999), (1, 2, -201), (99, 2, 999), (1, 99, 999), (1, 2, 202), (1, 3, 303)], "customer_id bigint, product_id bigint, cents bigint")
    assert collected(S.star_join_aggregate(sales, people, goods)) == sorted([("", 1, 101), ("品牌", 2, 1), (None, 1, 303)], key=str)


def sortable(spark, rows):
    us = spark.createDataFrame(rows, "us bigint, transaction_id bigint")
    return us.select(from_micros(F.col("us")).alias("transaction_timestamp"), "transaction_id")


def test_sort_wraps_and_breaks_ties(spark):
    rows = [(1, 4), (-1, 6), (0, 3), (1, 2**63 - 1), (1, 2), (253402300799999999, 2**63 - 2), (253402300799999998, 2**53 + 1)]
    r = S.sort(sortable(spark, rows)).first()
    ordered = [i for _, i in sorted(rows)]
    assert (r.first_id, r.last_id, int(r.positional_sum_mod_2_64)) == (ordered[0], ordered[-1], sum((k + 1) * i for k, i in enumerate(ordered)) % 2**64)


def test_sort_of_nothing(spark):
    r = S.sort(sortable(spark, [])).first()
    assert tuple(r) == (None, None, None)


def test_sort_is_not_one_partition(spark):
    plan = S.sort(sortable(spark, [(1, 1)]))._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan


def test_top_n_breaks_ties_by_id(spark):
    rows = [(c, 100) for c in range(105, 0, -1)] + [(105, 1), (1, -1), (2, -200)]
    got = [tuple(r) for r in S.top_n(spark.createDataFrame(rows, "customer_id bigint, cents bigint")).orderBy("rank").collect()]
    assert got[0] == (1, 105, 101) and got[1:] == [(c - 1, c, 100) for c in range(3, 102)]


def test_distinct_pairs_keep_nulls(spark):
    sales = spark.createDataFrame([(1, 1, 1, None), (1, 2, None, None), (None, 2, 1, None)], "customer_id bigint, product_id bigint, store_id int, transaction_date date")
    assert tuple(S.distinct_count(sales).first()) == (1, 2, 2)


def test_empty_and_all_null_aggregates(spark):
    empty = spark.createDataFrame([], "quantity int, cents bigint, is_returned boolean, country string")
    assert tuple(S.scan_aggregate(empty).first()) == (0, 0, None, None, None, None, 0)
    assert tuple(S.null_handling(empty).first()) == (0, 0, None, 0, 0)
    some = spark.createDataFrame([(None, 5, True, ""), (None, -7, False, None)], "quantity int, cents bigint, is_returned boolean, country string")
    assert tuple(S.scan_aggregate(some).first()) == (2, 0, None, -2, -7, 5, 1)
    assert tuple(S.null_handling(some).first()) == (2, 1, 2, 0, 1)


def test_unicode_keys_are_not_normalised(spark):
    sales = spark.createDataFrame([("Café", 1, 1), ("Café", 1, 1), ("", 1, 1), (None, 1, 1)], "country string, quantity int, cents bigint")
    assert S.groupby_low_cardinality(sales).count() == 4


def test_floor_division_and_money(spark):
    df = spark.createDataFrame([(-1,), (0,), (1999,), (-100,)], "c bigint").select(floor_div(F.col("c"), 1000).alias("q"), money_text(F.col("c")).alias("t"))
    assert [tuple(r) for r in df.collect()] == [(-1, "-1.99"), (0, "0.00"), (1, "19.99"), (-1, "-1.00")]
    ts = spark.createDataFrame([(-1,), (253402300799999999,)], "us bigint").select(micros(from_micros(F.col("us"))).alias("us"))
    assert [r.us for r in ts.collect()] == [-1, 253402300799999999]


def test_round_trips_see_lossy_values(spark):
    day = datetime.date(1969, 12, 31)
    rows = [(2**53, 1, 29, day, datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)), (1, 1, 100, day, datetime.datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "transaction_id bigint, customer_id bigint, cents bigint, transaction_date date, transaction_timestamp timestamp_ntz").where("transaction_id = 1")
    assert tuple(S.type_conversion_roundtrip(df).first()) == (0, 0, 0, 19691231)


def test_deduplicate_keeps_the_latest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d")], "k bigint, ts bigint, s string")
    assert collected(E.deduplicate(df, ["k"], ["ts", "s"])) == [(1, 7, "c"), (2, None, "d")]


def test_running_sum(spark):
    t = datetime.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, 2, t, 5), (1, 1, t, 7), (2, 3, t, 1)], "customer_id bigint, transaction_id bigint, transaction_timestamp timestamp_ntz, cents bigint")
    assert collected(S.running_sum(df)) == [(1, 1, 7), (1, 2, 12), (2, 3, 1)]


def test_json_and_time(spark):
    df = spark.createDataFrame([("a", '{"k": 5}'), ("a", "{}"), ("b", None)], "kind string, j string")
    assert collected(E.json_extract(df, "kind", "j", "$.k")) == [("a", 5, 1, 2), ("b", None, 0, 1)]
    ts = spark.createDataFrame([(datetime.datetime(1969, 12, 31, 23, 30),)], "ts timestamp_ntz")
    assert tuple(E.datetime_arithmetic(ts, "ts").first()) == (-3_600_000_000, -1, 0, 1)


def test_window_running_sum_wraps_and_keeps_null_days(spark):
    t = [datetime.datetime(2020, 1, d) for d in (1, 2)]
    rows = [(1, 1, t[0], 5), (1, 2, t[0], None), (1, 3, t[1], 7), (2, 4, t[1], -3), (2, 5, None, 1), (None, 6, t[0], 2), (3, 7, t[0], 2**62), (3, 8, t[0], 2**61), (3, 9, t[1], 1)]
    df = spark.createDataFrame(rows, "customer_id bigint, transaction_id bigint, transaction_timestamp timestamp_ntz, cents bigint")
    got = {r.customer_id: (r.last_running_cents, int(r.sum_running_mod_2_64)) for r in S.window_running_sum(df).collect()}
    assert got == {1: (12, 5 + 5 + 12), 2: (-2, (1 - 2) % 2**64), None: (2, 2), 3: (2**62 + 2**61 + 1, (2**62 + 2 * (2**62 + 2**61) + 1) % 2**64)}


def test_latest_by_id_and_payloads(spark):
    t = [datetime.datetime(2020, 1, d) for d in (1, 2)]
    rows = [(1, t[0], "b", 10), (1, t[1], "z", 11), (1, t[1], "c", 12), (2, None, "x", 13), (None, t[0], "n", 14)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, session_id string, user_id bigint")
    assert collected(E.latest_by_id(df)) == sorted([(1, t[1], "c", 12), (2, None, "x", 13)], key=str)
    rows = [("Click", '{"user":{"id":7},"action":"Click","amount":30}'), ("Click", '{"user":{"id":1},"action":"é"}'), ("Buy", None)]
    df = spark.createDataFrame(rows, "event_type string, payload_json string")
    assert collected(E.payload_json(df)) == sorted([("Click", 8, 30, 2), ("Buy", None, None, 1)], key=str)
    parts = [p.lower()[2:42].encode() for _, p in rows[:2]]
    assert collected(E.payload_strings(df)) == sorted([("Click", 1, sum(map(len, parts)), 2, 2), ("Buy", 0, None, None, 1)], key=str)
