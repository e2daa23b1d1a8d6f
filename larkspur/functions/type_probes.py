"""What Spark's types do at their edges, by the keys of the type-semantics catalogue: one SELECT of texts.

Keys with no counterpart (unsigned types, char) say so. ANSI mode is on; what it refuses is shown by try_ functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROBES = {
    "size_int8": "'1'", "size_int16": "'2'", "size_int32": "'4'", "size_int64": "'8'", "size_uint8": "'n/a'", "size_uint16": "'n/a'", "size_uint32": "'n/a'", "size_uint64": "'n/a'",
    "size_float32": "'4'", "size_float64": "'8'", "size_bool": "'1'", "size_char": "'n/a'", "char_meaning": "'no character type; strings are UTF-8'",
    "int32_max_plus_1": "coalesce(cast(try_add(2147483647, 1) as string), 'error')",
    "int64_max_plus_1": "coalesce(cast(try_add(9223372036854775807L, 1L) as string), 'error')",
    "uint8_255_plus_1": "'n/a'", "uint32_0_minus_1": "'n/a'",
    "int_div_m7_2": "cast(-7 div 2 as string)", "int_mod_m7_2": "cast(-7 % 2 as string)", "int_pmod_m7_2": "cast(pmod(-7, 2) as string)",
    "int_div_by_zero": "coalesce(cast(try_divide(1, 0) as string), 'error')",
    "f64_0_1_plus_0_2": "cast(0.1D + 0.2D as string)", "f32_16777217_roundtrip": "cast(cast(cast(16777217 as float) as int) as string)", "f64_2p53_plus_1": "cast(9007199254740992D + 1D as string)",
    "f64_nan_eq_nan": "cast(double('NaN') = double('NaN') as string)", "f64_1_div_0": "coalesce(cast(try_divide(1D, 0D) as string), 'error')", "f64_neg1_div_0": "coalesce(cast(try_divide(-1D, 0D) as string), 'error')", "f64_0_div_0": "coalesce(cast(try_divide(0D, 0D) as string), 'error')",
    "i64_2p53p1_via_f64": "cast(cast(cast(9007199254740993L as double) as bigint) as string)",
    **{f"str_{name}_{unit}": sql.format(text) for name, text in (("e_pre", "decode(unhex('C3A9'), 'UTF-8')"), ("e_comb", "decode(unhex('65CC81'), 'UTF-8')"), ("emoji", "decode(unhex('F09F9880'), 'UTF-8')")) for unit, sql in (("utf8", "cast(octet_length({0}) as string)"), ("utf16", "cast(octet_length(encode({0}, 'UTF-16BE')) div 2 as string)"), ("scalars", "cast(char_length({0}) as string)"))},
    "date_epoch_day_2015_01_01": "cast(unix_date(date'2015-01-01') as string)", "timestamp_max_precision": "'us'",
    "empty_array_index0": "coalesce(cast(get(cast(array() as array<int>), 0) as string), 'NULL')", "empty_array_max": "coalesce(cast(array_max(cast(array() as array<int>)) as string), 'NULL')",
    "empty_string_index0": "concat('\"', substring('', 1, 1), '\"')", "empty_string_split_count": "cast(size(split('', ',')) as string)",
    "map_order_3_1_2": "array_join(transform(map_keys(map(3, 0, 1, 0, 2, 0)), x -> cast(x as string)), ',')",
    "decimal_0_1_plus_0_2": "cast(0.1BD + 0.2BD as string)", "f64_sum_10m_0_1": "'see OP21: sums of doubles depend on the partitions'",
}


def type_probes(spark: SparkSession) -> DataFrame:
    """(key, value) of every probe."""
    cells = ", ".join(f"'{k}', {v}" for k, v in PROBES.items())
    return spark.sql(f"select stack({len(PROBES)}, {cells}) as (key, value)")
