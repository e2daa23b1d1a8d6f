"""Order-insensitive digests of results and tables.

Each task folds its rows into one row of sums modulo 2**64; only these come to the driver, whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalar import cents, micros
from larkspur.functions.wrapping import GOLDEN, MASK, MULTIPLIERS, SHIFTS, wrapping

# The stand-in for NULL, and FNV-1a's offset and prime.
NULL = 0xA5A5A5A5A5A5A5A5
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
# Fixed value: what separates the members of lists and maps in their text.
UNIT = "\x1f"


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & MASK
    return h


def mix_array(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip(SHIFTS, (*MULTIPLIERS, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _by_value(column: pa.Array, of) -> np.ndarray:
    """A 64-bit number for each text, computed once for each distinct one."""
    coded = column.dictionary_encode()
    known = np.array([of(s) for s in coded.dictionary.to_pylist()] or [0], np.uint64)
    return known[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)]


def canonical(column: pa.Array) -> np.ndarray:
    """Result values as unsigned numbers; floats have none."""
    kind = column.type
    if pa.types.is_floating(kind):
        raise TypeError("floats are not digested")
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        out = _by_value(column, lambda s: fnv1a(s.encode()))
    elif pa.types.is_decimal(kind):
        out = np.array([int(v or 0) & MASK for v in column.to_pylist()], np.uint64)
    elif pa.types.is_boolean(kind):
        out = column.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint64)
    else:
        out = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return np.where(missing, np.uint64(NULL), out)


def row_hashes(batch: pa.RecordBatch) -> np.ndarray:
    h = np.zeros(batch.num_rows, np.uint64)
    for column in batch.columns:
        h = mix_array(h + canonical(column) + np.uint64(GOLDEN))
    return h


def result_digest(df: DataFrame, floats: tuple[str, ...] = ()) -> tuple[str, int]:
    """(checksum, row count) of all columns but the named floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, xor = 0, 0, 0
        for batch in batches:
            h = row_hashes(batch)
            n, total, xor = n + len(h), (total + int(h.sum(dtype=np.uint64))) & MASK, xor ^ int(np.bitwise_xor.reduce(h))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (str(n), f"{total:016x}", f"{xor:016x}")], names=["n", "total", "xor"])

    n = total = xor = 0
    for r in df.drop(*floats).mapInArrow(run, "n string, total string, xor string").collect():  # a row for each task
        n, total, xor = n + int(r["n"]), (total + int(r["total"], 16)) & MASK, xor ^ int(r["xor"], 16)
    return f"{total:016x}{xor:016x}", n


def floats_agree(a: dict[str, float], b: dict[str, float], rtol: float = 1e-9) -> bool:
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=rtol) for k in a)


def canonical_table(df: DataFrame) -> DataFrame:
    """Published columns in canonical form: money as cents under *_cents, the rest as it is."""
    money = {f.name for f in df.schema.fields if f.dataType.simpleString() == "decimal(18,2)"}
    return df.select(*[cents(F.col(c)).alias(f"{c}_cents") if c in money else F.col(c) for c in df.columns])


def column_digests(df: DataFrame) -> dict[str, tuple[int, int]]:
    """Sum of canonical values modulo 2**64 and number of NULLs of each column of a table.

    Whole numbers, dates, times and booleans are summed by Spark itself. Only text, with lists and maps joined to text
    there, and floats, whose bits count, go through Arrow.
    """
    df = canonical_table(df)
    spark, kinds = df.sparkSession, {f.name: f.dataType.typeName() for f in df.schema.fields}
    whole = {"date": F.unix_date, "timestamp_ntz": micros, "timestamp": F.unix_micros}
    joined = {
        "array": lambda c: F.array_join(c, UNIT),
        "map": lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), UNIT),
    }
    by_arrow = [c for c, k in kinds.items() if k in ("string", "float", "double", *joined)]
    with wrapping(spark):
        sums = [F.sum(whole.get(k, lambda c: c)(F.col(c)).cast("bigint")).alias(f"s{i}") for i, (c, k) in enumerate(kinds.items()) if c not in by_arrow]
        nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(kinds)]
        found = df.agg(*nulls, *sums).first().asDict()
    out = {c: ((found.get(f"s{i}") or 0) & MASK, found[f"n{i}"]) for i, c in enumerate(kinds)}
    texts = df.select(*[joined.get(kinds[c], lambda x: x)(F.col(c)).alias(c) for c in by_arrow])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(by_arrow), np.uint64)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                total[i] += _bits(column.drop_null()).sum(dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.view(np.int64))], names=["at", "part"])

    if by_arrow:
        for r in texts.mapInArrow(run, "at int, part long").collect():  # a row for each task and column
            c = by_arrow[r["at"]]
            out[c] = ((out[c][0] + r["part"]) & MASK, out[c][1])
    return out


def _bits(column: pa.Array) -> np.ndarray:
    """XXH64 of texts, the bits of floats as doubles."""
    if pa.types.is_floating(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64)
    return _by_value(column, lambda s: xxhash.xxh64_intdigest(s.encode(), 0)) if len(column) else np.zeros(0, np.uint64)


def merged(a: dict, b: dict) -> dict:
    """Digest of two disjoint row ranges together."""
    return {c: ((a[c][0] + b[c][0]) & MASK, a[c][1] + b[c][1]) for c in a}


def table_digest(columns: dict[str, tuple[int, int]]) -> str:
    text = "|".join(f"{c}={s:016x}:{n}" for c, (s, n) in columns.items())
    return f"{xxhash.xxh64_intdigest(text.encode(), 0):016x}"
