import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import mixing as m


def targets(sizes, most=3):
    """Shares by weight with caps, excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    free, left, out = set(order), float(sum(sizes.values())), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def test_knapsack_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randrange(1, 6))))
        counts = np.array([rng.randrange(1, 4) for _ in lengths])
        budget = rng.randrange(0, 120)
        taken = m._knapsack(lengths, counts, budget) if budget else np.zeros(len(lengths), int)
        sums = {sum(a * b for a, b in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])}
        assert (taken <= counts).all() and (taken * lengths).sum() == max(s for s in sums if s <= budget)


def test_fill_keeps_within_counts_and_budget():
    rng = np.random.default_rng(2)
    lengths, counts = np.arange(1, 3000, 7), rng.integers(1, 50, 429)
    for share in (0, 0.1, 0.5, 0.999, 1, 2):
        budget = int(share * (lengths * counts).sum())
        taken = m.fill(lengths, counts, budget, table=4096)
        assert (0 <= taken).all() and (taken <= counts).all()
        assert min(budget, (lengths * counts).sum()) - (taken * lengths).sum() == 0


def rows():
    rng = random.Random(8)
    out = [(i, " ".join(["w"] * rng.randrange(1, 200)), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(400)]
    out += [(500, None, "en", "s1"), (501, "  ", "en", "s9"), (502, "one\x0btwo\x85three", "en", None), (None, "a b c", "en", None), (503, "x " * 40_000, "en", "big"), (7, "twice here", "en", "s2"), (7, "twice here", "en", "s2")]
    return out + [(600, "tiny", "en", "z"), (601, "", "en", "")]


def test_targets_shares_and_repeats(docs):
    data = rows()
    got = m.mix(docs(data)).collect()
    sizes = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    wanted = targets(sizes)
    assert len(got) == len(data)
    shown = sorted({(r.source_size, round(r.target, 6)) for r in got})
    assert shown == sorted({(sizes[s], round(wanted[s], 6)) for s in sizes})
    for size, target in shown:
        same = [s for s in sizes if sizes[s] == size and round(wanted[s], 6) == target]
        taken = sum(r.taken for r in got if r.source_size == size and round(r.target, 6) == target)
        assert abs(taken - target * len(same)) <= max(2, 0.05 * target) * len(same) or size < 50 or size == 40_000
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in got)


def test_reruns_agree(docs):
    a, b = (sorted(map(str, m.mix(docs(rows(), parts)).collect())) for parts in (2, 5))
    assert a == b


def test_empty(docs):
    assert m.mix(docs([])).count() == 0
    assert [r.taken for r in m.mix(docs([(1, None, None, None)])).collect()] == [0]


def test_carried_columns(docs):
    got = m.mix(docs([(1, "a b", "en", "s")]).withColumn("mine", F.lit(5)), carry=("mine", "source")).first()
    assert got.mine == 5 and got.source == "s"
