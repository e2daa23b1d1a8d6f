"""Near-duplicate detection with min-max hashing.

Every permutation of a document's shingle set is evaluated once and gives two signature values, its minimum and its
maximum. Bands of minima and bands of maxima propose candidates; a link needs the exact similarity of the full sets.
Documents with equal sets are one class from the start. In a bucket every class is first compared with the bucket's
smallest one only; buckets whose members then lie in more than one component are compared exhaustively, in chunks of
bounded size. No pair of the same component is ever made, so a group of copies costs its size, not its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import Numbers
from larkspur.llm.common import key_bits, maybe_in, trimmed, written
from larkspur.llm.graph import components

#: Classes of a bucket that are compared exhaustively in one task with those of one other chunk, on average.
CHUNK = 256

#: Shingles whose signatures are computed together.
STEP = 1 << 15

MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(Numbers):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; with fewer words, of the whole sequence; empty without any.

    bytes.lower() and bytes.split() know ASCII only: A-Z, and blank with the controls 9 to 13.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out *= MIX
        out += h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out))


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(sets: list[np.ndarray], hashes: int, rows: int, seed: int = 11) -> np.ndarray:
    """(sets, bands) 64-bit bucket numbers: half of the bands from minima, half from maxima. Sets are not empty."""
    rng = np.random.default_rng(seed)
    factor = (rng.integers(0, 1 << 31, hashes).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, hashes).astype(np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    low, high = np.empty((hashes, len(sets)), np.uint32), np.empty((hashes, len(sets)), np.uint32)
    for k in range(hashes):
        v = flat * factor[k]
        v ^= shift[k]
        low[k], high[k] = np.minimum.reduceat(v, begin), np.maximum.reduceat(v, begin)
    bands = hashes // rows
    out = np.empty((len(sets), 2 * bands), np.uint64)
    for half, values in enumerate((low, high)):
        for b in range(bands):
            h = np.full(len(sets), 1 + b + half * bands, np.uint64)
            for r in range(rows):
                h *= MIX
                h += values[b * rows + r]
                h = mixed(h)
            out[:, half * bands + b] = h
    return out


def _texts(batches: Iterator[pa.RecordBatch], words: int):
    known = WordHashes()
    for batch in batches:
        for doc_id, text in zip(batch[0].to_pylist(), batch[1]):
            if len(known) > 1 << 18:
                known.clear()
            yield doc_id, shingle_set(text.as_py(), words, known)


def signed(docs: DataFrame, words: int, hashes: int, rows: int) -> DataFrame:
    """(doc_id, n, key, bands) for each row of docs; key and bands are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, used = [], [], 0

        def batch() -> pa.RecordBatch:
            some = [s for s in sets if len(s)]
            found = iter(signatures(some, hashes, rows).view(np.int64)) if some else iter(())
            bands = [next(found) if len(s) else None for s in sets]
            columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "bands"])

        for doc_id, s in _texts(batches, words):
            ids.append(doc_id)
            sets.append(s)
            used += len(s)
            if used >= STEP:
                yield batch()
                ids, sets, used = [], [], 0
        if ids:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n long, key binary, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(rep, key, shingles) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, used = [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["rep", "key", "shingles"])

        for doc_id, s in _texts(batches, words):
            ids.append(doc_id)
            sets.append(s)
            used += len(s)
            if used >= STEP:
                yield batch()
                ids, sets, used = [], [], 0
        if ids:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "rep long, key binary, shingles array<long>")


def linked(percent: int):
    both = F.size(F.array_intersect("x", "y"))
    return F.lit(100) * both >= F.lit(percent) * (F.size("x") + F.size("y") - both)


def compared(percent: int):
    """Links that join the members of a group, by exact comparison of all that are not yet joined."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s) for s in group["shingles"]]
        parent = list(range(len(sets)))
        first: dict[int, int] = {}
        for i, c in enumerate(group["component"]):
            parent[i] = first.setdefault(c, i)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for i in range(len(sets)):
            for j in range(i):
                a, b = len(sets[i]), len(sets[j])
                if 100 * min(a, b) < percent * max(a, b) or root(i) == root(j):
                    continue
                same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * same >= percent * (a + b - same):
                    parent[root(i)] = root(j)
                    out.append((group["rep"].iloc[i], group["rep"].iloc[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, hashes: int = 60, rows: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id reachable over links, kept marks the document that is its own component. Texts without words are
    linked with nothing. Rows that repeat a doc_id are the same document; rows without a doc_id are linked with nothing
    and are kept with a null component_id. Texts of any length are one set; other columns are ignored; an empty table gives
    an empty result.

    With 60 hashes in bands of 5 there are 24 bands: a pair at 80 % is missed with probability 0.00007, one at 85 % with
    less than 0.000001.
    """
    docs = docs.select("doc_id", "text")
    signs = written(signed(docs, words, hashes, rows), "signs")
    classes = signs.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    members = written(classes.select("v", "rep", F.explode("bands").alias("bucket")), "members")
    centres = members.groupBy("bucket").agg(F.min(F.struct("rep", "v")).alias("c"), F.count("*").alias("size")).where("size > 1").select("bucket", F.col("c.rep").alias("c_rep"), F.col("c.v").alias("c_v"))
    centres = written(centres, "centres")  # a plain side of the join, which AQE can then split where a bucket is hot
    members = written(members.join(centres.hint("merge"), "bucket"), "members")  # of buckets with more than one class
    pairs = written(members.where("v != c_v").select("v", "rep", "c_v", "c_rep").distinct(), "pairs")
    wanted = members.select("v", "rep").distinct()
    sets = full_sets(maybe_in(docs.where("doc_id is not null"), "doc_id", key_bits(wanted, "rep")), words).where("key is not null")
    sets = sets.join(classes.select("v", "rep", "key").join(wanted.select("v").hint("merge"), "v", "left_semi").hint("merge"), ["rep", "key"]).select("v", "shingles")
    sets = written(sets.dropDuplicates(["v"]), "sets")
    tested = pairs.join(sets.select("v", F.col("shingles").alias("x")).hint("merge"), "v").join(sets.select(F.col("v").alias("c_v"), F.col("shingles").alias("y")).hint("merge"), "c_v")
    links = written(tested.where(linked(percent)).select(F.col("rep").alias("a"), F.col("c_rep").alias("b")), "links")
    # rows that repeat a doc_id are one document, so it joins the classes of all its texts
    several = signs.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    bridges = signs.select("doc_id", "key").join(several.hint("merge"), "doc_id").join(classes.select("key", "rep").hint("merge"), "key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(links.union(bridges))

    # buckets that still hold more than one component: all other pairs, in chunks; equal buckets once
    now = members.select("bucket", "v", "rep").join(labels.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    now = written(now, "now")
    split = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("v")).alias("h1"), F.sum(F.pmod(F.xxhash64(F.lit(1), F.col("v")), F.lit(1 << 40))).alias("h2")).where("low < high and size > 2")
    split = written(split.groupBy("size", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "split")
    # chunks by hash: no bucket is sorted in one task
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    rest = now.join(split.hint("merge"), "bucket").withColumn("chunk", F.pmod(F.xxhash64("v"), chunks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rest = rest.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "v", "rep", "component").join(sets.hint("merge"), "v")
    more = written(rest.groupBy("bucket", "i", "j").applyInPandas(compared(percent), "a long, b long"), "more")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    out = signs.join(classes.select("key", "rep").hint("merge"), "key", "left").join(labels.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.least(F.col("doc_id"), F.coalesce("component", "rep", "doc_id"))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
