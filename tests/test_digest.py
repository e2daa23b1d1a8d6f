import pytest

from larkspur import digest as d
from larkspur.functions.wrapping import GOLDEN, MASK, mix


def by_hand(rows):
    total = xor = 0
    for row in rows:
        h = 0
        for v in row:
            c = d.NULL if v is None else d.fnv1a(v.encode()) if isinstance(v, str) else int(v) & MASK
            h = mix(h + c + GOLDEN)
        total, xor = (total + h) & MASK, xor ^ h
    return f"{total:016x}{xor:016x}", len(rows)


def test_result_digest(spark):
    rows = [(1, "a", True), (-5, "é", False), (None, None, None), (2**63 - 1, "", True), (1, "a", True)]
    df = spark.createDataFrame(rows, "n bigint, s string, b boolean")
    assert d.result_digest(df) == by_hand(rows)
    assert d.result_digest(df.repartition(3)) == by_hand(rows)
    assert d.result_digest(df.where("false")) == ("0" * 32, 0)


def test_fnv_vector():
    assert d.fnv1a(b"") == 0xCBF29CE484222325 and d.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_floats_are_refused(spark):
    with pytest.raises(Exception, match="floats"):
        d.result_digest(spark.createDataFrame([(1.0,)], "x double"))
    assert d.result_digest(spark.createDataFrame([(1, 1.0)], "n bigint, x double"), ("x",))[1] == 1


def test_float_comparison():
    assert d.floats_agree({"a": 1.0}, {"a": 1.0 + 1e-12}) and not d.floats_agree({"a": 1.0}, {"a": 1.0001}) and not d.floats_agree({"a": 1.0}, {})
