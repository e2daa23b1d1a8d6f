"""The operations by number: what each reads, what it returns and the modes it has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from larkspur.operators import sales as S


@dataclass(frozen=True)
class Operation:
    number: str
    name: str
    run: Callable[..., DataFrame]
    columns: tuple[str, ...]  # of the sales frame, for pruning
    dims: tuple[str, ...] = ()
    floats: tuple[str, ...] = ()
    modes: tuple[str, ...] = ("materialized", "streaming")
    csv: bool = False


EVERY = ("transaction_id", "customer_id", "product_id", "store_id", "quantity", "cents", "discount", "tax", "country", "category", "transaction_date", "transaction_timestamp", "is_returned")

OPERATIONS = {
    o.number: o
    for o in (
        Operation("OP01", "scan_aggregate", S.scan_aggregate, ("quantity", "cents", "is_returned")),
        Operation("OP02", "filter_project", S.filter_project, ("transaction_id", "customer_id", "cents", "country", "discount", "is_returned")),
        Operation("OP03", "groupby_low_cardinality", S.groupby_low_cardinality, ("country", "quantity", "cents")),
        Operation("OP04", "groupby_high_cardinality", S.groupby_high_cardinality, ("customer_id", "cents")),
        Operation("OP05", "groupby_multi_key", S.groupby_multi_key, ("country", "category", "transaction_date", "cents")),
        Operation("OP06", "hash_join_aggregate", S.hash_join_aggregate, ("customer_id", "quantity", "cents"), ("dim_customer",)),
        Operation("OP07", "star_join_aggregate", S.star_join_aggregate, ("customer_id", "product_id", "cents"), ("dim_customer", "dim_product")),
        Operation("OP08", "sort", S.sort, ("transaction_id", "transaction_timestamp"), modes=("materialized",)),
        Operation("OP09", "top_n", S.top_n, ("customer_id", "cents")),
        Operation("OP10", "distinct_count", S.distinct_count, ("customer_id", "product_id", "store_id", "transaction_date")),
        Operation("OP11", "running_sum", S.window_running_sum, ("customer_id", "transaction_id", "transaction_timestamp", "cents"), modes=("materialized",)),
        Operation("OP15", "parse_csv", S.summarise_columns, EVERY, csv=True),
        Operation("OP19", "null_handling", S.null_handling, ("quantity", "country")),
        Operation("OP21", "decimal_arithmetic", S.decimal_arithmetic, ("cents",), floats=("naive_sum", "kahan_sum")),
        Operation("OP22", "type_conversion_roundtrip", S.type_conversion_roundtrip, ("transaction_id", "customer_id", "cents", "transaction_date", "transaction_timestamp")),
    )
}
