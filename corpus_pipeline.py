"""A training-corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, tokenising.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, exact_dedup, language_id, minhash, mixing
from larkspur.llm.common import key_bits, lower_ascii, maybe_flag, written
from larkspur.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A text whose most probable language has less than this is rejected, as is one without letters.
LEAST_SCORE = 0.3


def _smallest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of keys, the smallest by the other columns, so that reruns agree."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("one")).select(*[F.col(c) if c in keys else F.col(f"one.{c}") for c in rows.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null texts, empty ones, texts without letters, undecided ones.

    Texts of any length are read whole. Rows that repeat a doc_id are judged one by one; rows without one are like any
    other. It learns from non-null lang only. An empty table gives an empty result, here and in all stages, and columns besides those of documents are left out.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return language_id.kept(docs, ~held_out, LEAST_SCORE).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, the one with the largest doc_id; of rows that repeat it, the smallest by the other columns.

    Null texts equal empty ones. A null doc_id loses against any other; rows without a doc_id whose text no other row has stay.
    """
    verdicts = written(exact_dedup.exact_dedup(docs, keep="largest").select("doc_id", "text_sha256", "kept"), "verdicts")
    once = verdicts.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    touched = once.where("not kept or rows > 1").select("doc_id", "text_sha256", "kept", F.xxhash64("doc_id", "text_sha256").alias("key"))
    sha = F.sha2(lower_ascii(F.col("text")), 256)
    rows = docs.select(*COLUMNS, sha.alias("text_sha256")).withColumn("key", F.xxhash64("doc_id", "text_sha256"))
    rows = maybe_flag(rows, "key", key_bits(touched, "key"), "maybe")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.text_sha256") == F.col("t.text_sha256"))
    some = _smallest(rows.where("maybe"), "doc_id", "text_sha256").alias("d").join(touched.alias("t").hint("merge"), same, "left")
    some = some.where("t.kept is null or t.kept").select("d.*")
    return rows.where("not maybe").unionByName(some).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity of 0.8 or more), the smallest doc_id.

    Rows without a doc_id stay, and so do null and empty texts; rows that repeat a doc_id are one document and stay or go together.
    """
    dropped = written(minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct(), "dropped")
    rows = maybe_flag(docs.select(*COLUMNS).withColumn("key", F.xxhash64("doc_id")), "key", key_bits(dropped.withColumn("key", F.xxhash64("doc_id")), "key"), "maybe")
    some = rows.where("maybe").join(dropped.hint("merge"), "doc_id", "left_anti")
    return rows.where("not maybe").unionByName(some).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that each source comes near its target share of words.

    Null and empty texts have no words and are left out; a null source is one source, the last; rows that repeat doc_id, source
    and text are told apart only by the number of their copies.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("key"))
    copies = mixing.mix(keyed, carry=("key", "source")).groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.key") == F.col("c.key"))
    # equal rows are one row here, with the copies of all
    mixed = _smallest(keyed, "doc_id", "source", "key").alias("d").join(copies.alias("c").hint("merge"), same).select("d.*", "c.copies")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text decoded from them as a digest. Null and empty texts have no ids."""
    rows = bpe.decode(bpe.encode(docs, tokenizer_file()), tokenizer_file())
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mixing_stage),
    ("bpe", token_stage),
]

#: Neither a recurrent network nor the knapsack can be put in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
