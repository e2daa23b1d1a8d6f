import hashlib
import os
import re

import duckdb
import pytest

from larkspur.llm import queries as q


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, duck, name):
    duck.register("got", (q.QUERIES | q.PARTS)[name](spark, sf_dir).toArrow())
    duck.sql(f"create or replace table wanted as {q.ORACLE_SQL[name]}")
    kinds = [dict(r[:2] for r in duck.sql(f"describe {t}").fetchall()) for t in ("wanted", "got")]
    assert kinds[0] == kinds[1]
    columns = ", ".join(sorted(kinds[0]))
    one, two = (f"select {columns} from {t}" for t in ("wanted", "got"))
    assert duck.sql(f"({one} except all {two}) union all ({two} except all {one})").fetchall() == []


def test_digest_columns_of_the_secret_scan(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in q.op10_secret_scan(spark, sf_dir).collect():
        spans = [s for s in r.spans.split(",") if s]
        base = [s for s in spans if not s.startswith("random:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert [sum(s.startswith(f"{k}:") for s in base) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]
        assert all(re.fullmatch(r"[0-9a-f]{24,}", texts[r.doc_id][int(a) : int(b)]) for k, a, b in (s.split(":") for s in base) if k == "hex")


def test_every_operator_has_its_query():
    assert [n for n in q.QUERIES if n != "pipeline"] == sorted((n for n in q.QUERIES if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in q.QUERIES if n != "pipeline"} == set(range(1, 11))


def test_crc32_in_sql(duck):
    import zlib

    for text in ("0", "7", "12345678901", "-5"):
        assert duck.sql(f"select {q.crc32_sql(repr(text))}").fetchall()[0][0] == zlib.crc32(text.encode())
