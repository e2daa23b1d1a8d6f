"""Exact top-k inner-product search with one KD-tree for each shard.

Vectors are dealt to shards of bounded size by a hash of their id. A shard's tree splits at medians of the widest
component, and every node keeps its tight bounding box, from which the largest inner product that any of its vectors can
have with a query follows. A query starts at the root and always opens its best open node: an inner node's children get
their bounds, a leaf's vectors their scores; it stops when no open node's bound can beat its
kth score. Queries come in blocks of bounded size: a first pass goes down to the first leaf of each shard only, the kth scores
found are sent along, and the second pass prunes with them from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import written
from larkspur.storage import table_path

#: Vectors of a leaf and, on average, of a shard; queries of a block.
LEAF, SHARD, BLOCK = 64, 16_384, 4_096

#: Sums of products up to this size are exact in doubles.
EXACT = 1 << 53


@dataclass
class Tree:
    """Nodes in the order of their making: the vectors first to last, bounding boxes, the left child (the right one follows) or -1 for a leaf."""

    ids: np.ndarray
    vectors: np.ndarray  # by node
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """Median splits of the component with the widest range until a node has at most `leaf` vectors, or equal ones only."""
    order, nodes, left = np.arange(len(ids)), [(0, len(ids))], []
    low, high = [], []
    for a, b in nodes:  # grows as nodes are split
        part = vectors[order[a:b]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        wide = high[-1] - low[-1]
        if b - a <= leaf or not wide.any():  # equal vectors can't be split by a plane
            left.append(-1)
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, int(wide.argmax())], middle)]
        left.append(len(nodes))
        nodes += [(a, a + middle), (a + middle, b)]
    bounds = np.array(nodes)
    return Tree(ids[order], vectors[order], bounds[:, 0], bounds[:, 1], np.array(left), np.array(low), np.array(high))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T: by doubles where they are exact, else by 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**63:
        raise ValueError("inner products exceed 64 bits")
    return a @ b.T


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with anything in its own box."""
    return np.where(queries > 0, queries * high, queries * low).sum(axis=1)


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, only_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k vectors of the tree for each query (row, id, score), own id excluded; ties to the smaller id.

    floor: a score that k other vectors reach already, -2**63 where unknown: lower ones are left out. only_first: as far
    as the first leaf. All queries go on together, each with its own best open node.
    """
    least = np.iinfo(np.int64).min
    most = float(np.abs(queries).max(initial=0)) * max(float(np.abs(tree.low).max(initial=0)), float(np.abs(tree.high).max(initial=0))) * queries.shape[1]
    if most >= 2.0**63:
        raise ValueError("inner products exceed 64 bits")
    best_score = np.full((len(ids), k), least)
    best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
    found = np.zeros((len(ids), k), bool)
    open_ = np.full((len(ids), len(tree.left)), least)  # bounds of open nodes
    is_open = np.zeros(open_.shape, bool)
    root = np.zeros(len(ids), np.int64)
    open_[:, 0], is_open[:, 0] = bounds(queries, tree.low[root], tree.high[root]), True
    live = np.arange(len(ids))
    while len(live):
        at = open_[live].argmax(axis=1)
        kth = np.maximum(floor[live], np.where(found[live, -1], best_score[live, -1], least))
        on = is_open[live, at] & (open_[live, at] >= kth)  # an equal score may still have a smaller id
        live, at = live[on], at[on]
        open_[live, at], is_open[live, at] = least, False
        inner = tree.left[at] >= 0
        for step in range(2):
            rows, child = live[inner], tree.left[at[inner]] + step
            open_[rows, child], is_open[rows, child] = bounds(queries[rows], tree.low[child], tree.high[child]), True
        at_leaf, leaf = live[~inner], at[~inner]
        by = np.argsort(leaf, kind="stable")
        starts = np.concatenate([[0], np.flatnonzero(np.diff(leaf[by])) + 1]) if len(by) else np.zeros(0, np.int64)
        for a, b in zip(starts, np.append(starts[1:], len(by))):
            rows, node = at_leaf[by[a:b]], leaf[by[a]]
            _improve(rows, slice(tree.first[node], tree.last[node]), tree, ids, queries, best_score, best_id, found)
        if only_first:
            live = live[inner]
    row, column = np.nonzero(found & (best_score >= floor[:, None]))
    return row, best_id[row, column], best_score[row, column]


def _improve(rows: np.ndarray, own: slice, tree: Tree, ids: np.ndarray, queries: np.ndarray, best_score: np.ndarray, best_id: np.ndarray, found: np.ndarray) -> None:
    """Takes a leaf's vectors into the best ones of some queries, LEAF at a time."""
    k = best_score.shape[1]
    for a in range(own.start, own.stop, LEAF):
        some = slice(a, min(a + LEAF, own.stop))
        score = products(queries[rows], tree.vectors[some])
        names = np.broadcast_to(tree.ids[some], score.shape)
        ok = names != ids[rows, None]
        score = np.concatenate([best_score[rows], np.where(ok, score, np.iinfo(np.int64).min)], axis=1)
        names = np.concatenate([best_id[rows], np.where(ok, names, np.iinfo(np.int64).max)], axis=1)
        real = np.concatenate([found[rows], ok], axis=1)
        pick = np.lexsort((names, -score.astype(np.float64) if np.abs(score[real]).max(initial=0) < EXACT else ~score, ~real), axis=1)[:, :k]
        best_score[rows], best_id[rows], found[rows] = (np.take_along_axis(x, pick, axis=1) for x in (score, names, real))


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors without null or non-finite components: floor(scale * x)."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    good &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).cast("array<long>").alias("v"))


#: Fields of a tree as columns.
PARTS = ("ids", "vectors", "first", "last", "left", "low", "high")


def _matrix(batch: pa.Array, size: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def shards(rows: DataFrame, shard: int) -> DataFrame:
    """One tree a row, as bytes: (size, shard, tree). rows: (vec_id, v); vectors of one size share trees."""
    n = rows.count()
    dealt = rows.withColumn("size", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-n // shard)))))

    def run(table: pa.Table) -> pa.Table:
        size, number = table["size"][0].as_py(), table["shard"][0].as_py()
        tree = build(table["vec_id"].to_numpy(), _matrix(table["v"].combine_chunks(), size))
        parts = {k: getattr(tree, k).astype("<i8").tobytes() for k in PARTS}
        return pa.table({"size": pa.array([size], pa.int32()), "shard": pa.array([number], pa.int64()), **{k: pa.array([p], pa.binary()) for k, p in parts.items()}})

    return written(dealt.groupBy("size", "shard").applyInArrow(run, "size int, shard long, " + ", ".join(f"{k} binary" for k in PARTS)), "shards")


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best vectors but itself, ties to the smaller vec_id.

    vectors: (vec_id, embedding); is_query: a boolean column over vec_id. Components become floor(scale * x), the score
    is their integer inner product. Vectors that are null, empty or hold null or non-finite components take no part,
    nor do those without vec_id. Vectors of another size than the query's are not compared with it. Rows that repeat a
    vec_id are separate candidates of other queries, none of their own; as queries they are one, the first by value.
    Scores past 64 bits are refused; an empty table gives an empty result. Queries go out in blocks of at most `block`, so what is broadcast has a fixed size.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale), "quantised")
    trees = shards(rows, shard)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(queries.withColumn("size", F.size("v")), "queries")
    n = queries.count()
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(1 if n <= block else -(-2 * n // block))))
    path = None
    for size, number in sorted((r[0], r[1]) for r in queries.select("size", "block").distinct().collect()):
        some = queries.where((F.col("size") == size) & (F.col("block") == number)).select("vec_id", "v").orderBy("vec_id").toArrow()
        for a in range(0, some.num_rows, block):
            part = some.slice(a, block)
            ids, matrix = part["vec_id"].to_numpy(), _matrix(part["v"].combine_chunks(), size)
            path = path or table_path(spark, "found")
            _searched(trees.where(F.col("size") == size), ids, matrix, k).write.mode("append").parquet(path)  # a plan for each block only
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def _searched(trees: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    spark = trees.sparkSession
    size = matrix.shape[1]
    ranks = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def passed(floor: np.ndarray, only_first: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix, floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, floor = shared.value
            floor = floor.copy()
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    parts = dict(zip(PARTS, (np.frombuffer(x, "<i8").astype(np.int64) for x in row)))
                    tree = Tree(**{k: v.reshape(-1, size) if k in ("vectors", "low", "high") else v for k, v in parts.items()})
                    at, found, score = search(tree, ids, matrix, k, floor, only_first)
                    if not only_first and len(at):  # the kth score goes along to the task's next shard
                        full = np.flatnonzero(np.bincount(at, minlength=len(ids)) == k)
                        least = np.full(len(ids), np.iinfo(np.int64).max)
                        np.minimum.at(least, at, score)
                        floor[full] = np.maximum(floor[full], least[full])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

        found = trees.select(*PARTS).mapInArrow(run, "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)

    known = passed(np.full(len(ids), np.iinfo(np.int64).min), True).where(F.col("rank") == k).select("query_id", "score").toArrow()
    floor = np.full(len(ids), np.iinfo(np.int64).min)
    floor[np.searchsorted(ids, known["query_id"].to_numpy())] = known["score"].to_numpy()
    return passed(floor, False).select("query_id", "rank", "vec_id", "score")
