import hashlib

from pyspark.sql import functions as F

from larkspur.llm import exact_dedup as x

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, pick):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for d, t in rows:
        body = (t or "").translate(LOWER)
        ids = [i for i in groups[body] if i is not None]
        keep = pick(ids) if ids else None
        out.append((d, keep, len(groups[body]), d == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Same text"), (2, "same TEXT"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200_000), (8, "X" * 200_000), (9, "alone"), (9, "alone"), (None, "alone"), (None, None), (None, "only null id"), (10, "İSTANBUL"), (11, "i̇stanbul")]


def test_both_ends_against_brute_force(docs):
    for keep, pick in (("largest", max), ("smallest", min)):
        got = x.exact_dedup(docs(ROWS), keep)
        assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, pick)


def test_colliding_digests_are_told_apart_by_bytes(docs):
    got = x.exact_dedup(docs(ROWS), "largest", digest=lambda body: F.pmod(F.xxhash64(body), F.lit(3)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, max)


def test_empty(docs, spark):
    assert x.exact_dedup(docs([]), "largest").count() == 0


def test_index_takes_batches_and_looks_up(docs, spark):
    index = x.DigestIndex(spark)
    index.flush(docs([(1, "a"), (2, "b")]))
    index.flush(docs([(3, "A"), (4, "c")]))
    level = {r.smallest: (r.largest, r.n) for r in index.compact().collect()}
    assert level == {1: (3, 2), 2: (2, 1), 4: (4, 1)}
    digest = spark.range(1).select(F.xxhash64(F.lit("a"))).first()[0]
    assert sorted(r.doc_id for r in index.lookup(digest).collect()) == [1, 3]


def test_no_python_in_the_plan(docs):
    plan = x.exact_dedup(docs(ROWS), "largest")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
