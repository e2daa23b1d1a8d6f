"""Exact deduplication by a log-structured merge index of text digests.

A batch of documents is flushed as level-0 runs: every task is a memtable that sorts its (digest, doc_id) pairs and
writes one file, whose footer holds minimum, maximum and a Bloom filter of the digests. Compaction merges all runs into
one level-1 run with a row per digest: the smallest and the largest identifier and the count. A digest that came more
than once is a hit only; the normalised bytes of the hits are then compared, so a digest collision can't join two
texts. Digests and identifiers are all that moves for the rest; copies collapse in the map-side aggregation, so a text
that a third of all documents share costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import key_bits, lower_ascii, maybe_in, written
from larkspur.storage import table_path


class DigestIndex:
    """Runs of (digest, doc_id, sha) in the shared folder; flush() may be called for any number of batches."""

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] = F.xxhash64, memtable_rows: int = 100_000):
        self.spark, self.digest, self.memtable_rows = spark, digest, memtable_rows
        self.runs: list[str] = []
        self.schema = None

    def keyed(self, docs: DataFrame) -> DataFrame:
        body = lower_ascii(F.col("text"))
        return docs.select("doc_id", body.alias("body")).withColumn("digest", self.digest(F.col("body")))

    def flush(self, docs: DataFrame) -> None:
        run = self.keyed(docs).select("digest", "doc_id", F.unhex(F.sha2("body", 256)).alias("sha"))
        path = table_path(self.spark, "run")
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.memtable_rows), "parquet.bloom.filter.max.bytes": "131072"}
        run.sortWithinPartitions("digest", "doc_id").write.options(compression="zstd", **bloom).parquet(path)
        self.runs.append(path)
        self.schema = run.schema

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.runs)

    def lookup(self, digest: int) -> DataFrame:
        """The entries of one digest; minimum, maximum and Bloom filter of each run spare the files without it."""
        return self.entries().where(F.col("digest") == digest)

    def compact(self) -> DataFrame:
        """Level 1: one row per digest, sorted by it within each file."""
        merged = self.entries().groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.count("*").alias("n"))
        return written(merged.sortWithinPartitions("digest"), "level1")


def exact_dedup(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text equals the empty one. keep is "smallest" or
    "largest": the row with that doc_id stays. A null doc_id loses against any other; where all ids of a group are null,
    keep_id is null and the rows count as kept. Rows that repeat doc_id and text share one verdict. Texts of any length are compared whole. Columns besides
    doc_id and text are ignored, whatever their names; an empty table gives an empty result.
    """
    index = DigestIndex(docs.sparkSession, digest)
    index.flush(docs)
    level1 = index.compact()
    hits = level1.where("n > 1").select("digest")
    # only the texts of hits move, and of the few strangers that pass the filter, which stay groups of one; equal bytes
    # meet in the map-side aggregation first
    bodies = maybe_in(index.keyed(docs), "digest", key_bits(hits, "digest"))
    classes = written(bodies.groupBy("digest", "body").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.count("*").alias("n")), "classes")
    by_digest = classes.groupBy("digest").agg(F.count("*").alias("k"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
    by_digest = written(by_digest, "hits")  # a plain side of the join below, which AQE can then split where a text is hot
    collided = by_digest.where("k > 1").select("digest")
    entries = index.entries()
    out = entries.join(by_digest.hint("merge"), "digest", "left").where("k is null or k = 1").select("doc_id", "sha", *_chosen(keep))
    if not collided.isEmpty():
        exact = index.keyed(docs).join(collided, "digest", "left_semi").join(classes, ["digest", "body"])
        sha = F.unhex(F.sha2("body", 256)).alias("sha")
        out = out.unionByName(exact.select("doc_id", sha, *_chosen(keep)))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _chosen(keep: str) -> list[Column]:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    own = F.col("n").isNull()
    return [F.when(own, F.col("doc_id")).otherwise(F.col(keep)).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size")]
