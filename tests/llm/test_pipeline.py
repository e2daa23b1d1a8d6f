from pyspark.sql import functions as F

import corpus_pipeline as p


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*p.COLUMNS).collect()), key=str)


def test_exact_stage_drops_copies_only(spark):
    rows = [(1, "Same", "en", "a", 4), (2, "same", "en", "a", 4), (5, "other", "en", "a", 5), (5, "SAME", None, "b", 4), (6, "other", "en", "a", 5), (6, "other", "en", "a", 5), (5, "unique", "en", "a", 6), (None, "same", "en", "a", 4), (None, "mine", "en", None, 4)]
    left = rows_of(p.exact_stage(spark, frame(spark, rows), ""))
    assert left == sorted([(5, "SAME", None, "b", 4), (6, "other", "en", "a", 5), (5, "unique", "en", "a", 6), (None, "mine", "en", None, 4)], key=str)


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "en", "a", 1), (2, text + " more", "en", "a", 1), (3, "quite different words in this one", "en", "a", 1), (None, text, "en", "a", 1), (4, None, None, None, None)]
    assert [r[0] for r in rows_of(p.near_stage(spark, frame(spark, rows), ""))] == [1, 3, 4, None]


def test_mixing_stage_makes_the_copies(spark):
    rows = [(i, "a b c d", "en", "x", 7) for i in range(20)] + [(100, "a b c d", "en", "y", 7), (101, None, "en", "y", 0), (7, "a b c d", "en", "x", 7)]
    docs = frame(spark, rows)
    wanted = {r[0]: r[1] for r in p.mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies")).collect()}
    got = {r[0]: r[1] for r in p.mixing_stage(spark, docs, "").groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in wanted.items() if v}


def test_language_stage_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = frame(spark, [(10**9, None, None, None, None), (10**9 + 1, "12 34 !!", "en", "a", 8), (10**9 + 2, "", "en", "a", 0)])
    left = {r[0] for r in p.language_stage(spark, docs.select(*p.COLUMNS).union(extra), sf_dir).select("doc_id").collect()}
    assert not any(x >= 10**9 for x in left) and len(left) >= 0.99 * docs.count()


def test_whole_run(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe"] and p.ORACLE_SQL is None
    assert out.count() > 0 and out.where("n_tokens <> size(ids)").count() == 0


def test_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0
