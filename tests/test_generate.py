import pytest
from pyspark.sql import functions as F

from larkspur import digest
from larkspur.operators.files import framed
from larkspur.plans.registry import OPERATIONS
from larkspur.sources import generate as g

# Digests of the sales table and result checksums at 1,000 and 10,000 rows.
TABLE = {1000: "ad9c536c421ed1b4", 10000: "bb4053ee05018095"}
RESULTS = {
    ("OP01", 1000): ("623409b57c030991623409b57c030991", 1),
    ("OP01", 10000): ("04fcd5c68d69a78304fcd5c68d69a783", 1),
    ("OP03", 1000): ("2af31df178d3ec4e9757d42aec030de4", 41),
    ("OP03", 10000): ("0d2aca5330297da3992feeb2ab467427", 43),
    ("OP04", 1000): ("c0b46d4ca74820b5d5398e700f3d4adf", 99),
    ("OP04", 10000): ("f7d93e64e9ef2ebf994b4744d26b5961", 993),
    ("OP05", 1000): ("d3a452a5247dbdc862aeb623bb31c36e", 970),
    ("OP05", 10000): ("ecf9cff971c012c5b3cde1fafd6a1da5", 8503),
    ("OP06", 1000): ("ba9148b52117300bb93a9690fcc8433d", 6),
    ("OP06", 10000): ("12b3b16a61882e7ac8a27e6d09ea3344", 6),
    ("OP07", 1000): ("8f341cc8d8105987fcad74ccb5a4f58b", 10),
    ("OP07", 10000): ("8743ebf04f5d686d90a17c2278605d59", 90),
    ("OP08", 1000): ("9e91768ab942cc179e91768ab942cc17", 1),
    ("OP08", 10000): ("afde1ca0118dfa39afde1ca0118dfa39", 1),
    ("OP09", 1000): ("0c8e08ac100f04af6449690a44da2edf", 99),
    ("OP09", 10000): ("7d13d9a9bac71f13e34e086d1504896b", 100),
    ("OP10", 1000): ("2cb3ad42cc481bad2cb3ad42cc481bad", 1),
    ("OP10", 10000): ("e74d659164fe6409e74d659164fe6409", 1),
    ("OP15", 1000): ("b743c0003d810274b743c0003d810274", 1),
    ("OP15", 10000): ("8ad689143bba2fcf8ad689143bba2fcf", 1),
    ("OP19", 1000): ("fac91b25a0e9094cfac91b25a0e9094c", 1),
    ("OP19", 10000): ("78bef3ea6dc6826778bef3ea6dc68267", 1),
    ("OP21", 1000): ("86fc6e326f0daf1586fc6e326f0daf15", 1),
    ("OP21", 10000): ("d3599a7df0ea2617d3599a7df0ea2617", 1),
    ("OP22", 1000): ("094340153b448d0a094340153b448d0a", 1),
    ("OP22", 10000): ("e19d935006076bfce19d935006076bfc", 1),
}
FLOATS = {1000: {"naive_sum": 1282865.8799999973, "kahan_sum": 1282865.88}, 10000: {"naive_sum": 12423468.400000019, "kahan_sum": 12423468.4}}


@pytest.mark.parametrize("n", [1000, 10000])
def test_data_and_every_result_have_the_published_digests(spark, n):
    scale = g.Scale(n)
    sales = g.sales_fact(spark, scale)
    assert digest.table_digest(digest.column_digests(sales)) == TABLE[n]
    frame = framed(sales).cache()
    dims = {t: g.GENERATORS[t](spark, scale) for t in ("dim_customer", "dim_product")}
    for (number, rows), wanted in RESULTS.items():
        if rows == n:
            operation = OPERATIONS[number]
            result = operation.run(frame, *[dims[d] for d in operation.dims])
            assert digest.result_digest(result, operation.floats) == wanted, number
            if operation.floats:
                assert digest.floats_agree({k: result.first()[k] for k in operation.floats}, FLOATS[n])
    frame.unpersist()


@pytest.mark.parametrize("table", list(g.GENERATORS))
def test_any_chunking_gives_the_same_rows(spark, table):
    scale = g.Scale(2000)
    whole = digest.column_digests(g.GENERATORS[table](spark, scale))
    n, parts = scale.table_rows(table), None
    for first in range(0, n, 777):
        part = digest.column_digests(g.GENERATORS[table](spark, scale, first=first, count=777))
        parts = part if parts is None else digest.merged(parts, part)
    assert parts == whole


def test_distribution_and_edges(spark):
    sales = g.sales_fact(spark, g.Scale(100_000), price_as="cents")
    r = sales.agg(F.min("unit_price").alias("low"), F.max("unit_price").alias("high"), F.avg(F.col("quantity").isNull().cast("double")).alias("missing"), F.max("customer_id").alias("most"), F.avg(F.col("is_returned").cast("double")).alias("back"), F.count_if(F.col("transaction_timestamp").cast("date") != F.col("transaction_date")).alias("off")).first()
    assert 99 <= r.low and r.high <= 999_999 and 0.0004 < r.missing < 0.002 and r.most <= 10_000 and 0.03 < r.back < 0.07 and r.off == 0
    edges = {x[0] for x in sales.select("country").distinct().collect()} | {x[0] for x in sales.select("category").distinct().collect()}
    assert {"", "Côte d'Ivoire \U0001f1e8\U0001f1ee", "Café", "Café", None} <= edges


def test_seed_changes_the_data(spark):
    a, b = (digest.column_digests(g.dim_customer(spark, g.Scale(1000), seed)) for seed in (1, 2))
    assert a["segment"] != b["segment"] and a["customer_id"] == b["customer_id"]


def test_scales_and_guard():
    assert [g.rows_of(x) for x in ("1k", "10m", "1b", 37, "1_000")] == [1000, 10**7, 10**9, 37, 1000]
    assert g.label_of(10**7) == "10m" and g.label_of(1234) == "1234"
    assert g.Scale(10**9).customers == 50_000_000 and g.Scale(5).products == 10
    with pytest.raises(ValueError):
        g.refuse_beyond(["sales_fact"], g.Scale(10**9), "csv", 20)
    with pytest.raises(ValueError):
        g.rows_of("0")
