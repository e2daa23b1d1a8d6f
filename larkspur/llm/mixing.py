"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word budget; whole passes over the source use up most of it, and a bounded-knapsack dynamic program
over the exact document lengths finds the documents that fill the rest. The program sees a histogram (length, count) of
one source, never its documents, so a source with a third of all rows costs no more than a small one. The documents of
a length are then drawn in a seeded order, whose rank is built from counts by hash range: no group is sorted in one
task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, written

#: Ranges of the seeded order into which the documents of one source and length are dealt.
RANGES = 1024


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their sum comes near budget.

    A proportional share of every length comes first and keeps the source's length mix; what it leaves is brought under
    `table` words by taking single documents, those with the largest lost fraction first, and the last part is solved
    exactly by dynamic programming over reachable sums, from below. Where most is taken, the same finds the documents to
    leave out, since few would remain to fill the rest with. lengths are positive and distinct.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    budget = min(int(budget), total)
    taken = np.zeros_like(counts)
    if budget <= 0:
        return taken
    if 2 * budget > total:
        return counts - fill(lengths, counts, total - budget, table)
    share = counts * (budget / total)
    taken = np.minimum(np.floor(share).astype(np.int64), counts)
    rest = budget - int((lengths * taken).sum())
    while rest < 0:  # rounding of very large products
        i = int(np.flatnonzero(taken)[np.argmin(lengths[taken > 0])])
        taken[i] -= 1
        rest += int(lengths[i])
    for i in np.lexsort((lengths, taken - share)):
        if rest <= table:
            break
        if taken[i] < counts[i] and lengths[i] <= rest:
            taken[i] += 1
            rest -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= table:
            break
        k = min(int(counts[i] - taken[i]), rest // int(lengths[i]))
        taken[i] += k
        rest -= k * int(lengths[i])
    if rest > 0:
        taken += _knapsack(lengths, counts - taken, rest)
    return taken


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: reachable sums up to budget, each with the item that reached it first."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    first = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, size = int(lengths[i]), int(counts[i]), 1
        left = min(left, budget // length)
        while left > 0 and not reached[budget]:
            k = min(size, left)
            w = k * length
            if w <= budget:
                new = np.flatnonzero(reached[: budget + 1 - w] & ~reached[w:]) + w
                first[new] = len(items)
                reached[new] = True
                items.append((int(i), k))
            left -= k
            size *= 2
        if reached[budget]:
            break
    out = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = items[first[at]]
        out[i] += k
        at -= k * int(lengths[i])
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, sid, source_size, target) from (source, size): one row per source.

    Sources by code point, null last, weigh weights in turn and share all words; a target stops at `most` times the
    source's size and the excess goes to the others by weight. That is the level at which sum(min(cap, level * weight))
    equals all words; the caps bind in the order of cap / weight, and of the levels that leave their own source uncapped the highest is right. Only one row per source is ordered here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("double"))
    every, upto = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns({"words": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "bound": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "used": F.coalesce(F.sum("weight").over(upto), F.lit(0.0))})
    level = (F.col("words") - F.col("bound")) / (F.col("all_weight") - F.col("used"))
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level)).withColumn("level", F.max("level").over(every))
    return ranked.select("source", "sid", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken.

    size counts the words of the whole text (null: 0), taken = size * copies with copies from 0 to `most`. A document without
    words is never taken. Null sources are one source, the last; a null doc_id takes part like any other; rows that
    repeat a doc_id are separate documents, told apart only by rank. Reruns agree. An empty table gives an empty result. Other columns are ignored, but for those in carry (none named like a column of
    the result), which are passed on.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = written(docs.select("doc_id", "source", size.alias("size"), order.alias("order"), *[c for c in carry if c != "source"]), "sizes")
    targets = written(source_targets(rows, weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size"))).cast("long")).otherwise(F.lit(0).cast("long"))
    targets = targets.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    same = F.col("t.source").eqNullSafe(F.col("r.source"))
    rows = rows.alias("r").join(targets.alias("t"), same).select("doc_id", "size", "order", "sid", "source_size", "target", "whole", "rest", *[F.col(f"r.{c}") for c in carry])
    rows = written(rows.withColumn("range", F.shiftrightunsigned("order", 64 - RANGES.bit_length() + 1)), "ranged")
    held = rows.where("size > 0 and rest > 0 and whole < " + str(int(most))).groupBy("sid", "size", "range").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))

    def quota(group: pd.DataFrame) -> pd.DataFrame:
        return group[["sid", "size"]].assign(quota=fill(group["size"].to_numpy(), group["n"].to_numpy(), int(group["rest"].iloc[0])))

    held = written(held, "held")
    lengths = held.groupBy("sid", "size").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    quotas = lengths.groupBy("sid").applyInPandas(quota, "sid int, size long, quota long")
    before = F.coalesce(F.sum("n").over(W.partitionBy("sid", "size").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("before", before).join(quotas, ["sid", "size"]).select("sid", "size", "range", "before", "quota")
    held = written(held, "quotas")
    rows = rows.join(held.hint("merge"), ["sid", "size", "range"], "left")
    rank = F.row_number().over(W.partitionBy("sid", "size", "range").orderBy("order", "doc_id")) + F.col("before")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce((rank <= F.col("quota")).cast("long"), F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *carry)
