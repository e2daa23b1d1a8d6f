import random

import numpy as np

from larkspur.llm import minhash as m
from larkspur.llm.graph import components


def sets_of(rows, words=5):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out.setdefault(d, []).append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, percent):
    sets = sets_of(rows)
    ids = sorted(d for d in sets if d is not None)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in ids}


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90)))) for i in range(30)]
    for i in range(100, 150):  # near copies with a few words changed
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(200, "One Two"), (201, "one  two\n"), (202, "one two three"), (203, None), (204, ""), (205, " \t "), (206, "One Two"), (206, "one two three"), (207, "a b c d e " * 5000), (208, "A B C D E " * 5000)]
    return rows


def check(got, rows, percent):
    wanted, sets = brute(rows, percent), sets_of(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == wanted[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_against_brute_force(docs):
    rows = cases()
    for percent in (80, 85):
        check(m.near_duplicates(docs(rows), percent).collect(), rows, percent)


def test_chains_that_miss_the_smallest_member(docs):
    """a is linked to b and b to c, but not a to c; and pairs whose bucket's smallest member is linked to neither."""
    words = [f"x{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[12:] + ["p"] * 1)), (3, " ".join(words[24:]))]
    rows += [(10, " ".join(words[:100] + [f"y{i}" for i in range(100)])), (11, " ".join(words[2:100] + [f"y{i}" for i in range(100)]))]
    check(m.near_duplicates(docs(rows), 80).collect(), rows, 80)


def test_rows_without_id_stay_alone(docs):
    got = m.near_duplicates(docs([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("None", "None", True), ("None", "None", True)]


def test_empty(docs):
    assert m.near_duplicates(docs([])).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    agree = []
    for k in range(30):
        a, b = np.unique(np.concatenate([base[:600], base[600:750] + np.uint64(k)])), np.unique(np.concatenate([base[:600], base[750:] + np.uint64(k)]))
        x, y = m.signatures([a, b], 60, 1)
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 600 / 900) < 0.05


def test_exhaustive_step_joins_what_the_star_missed():
    import pandas as pd

    rows = [(1, 1, [1, 2, 3, 4, 5]), (2, 2, [6, 7, 8, 9, 10]), (3, 3, [6, 7, 8, 9, 10, 11])]
    group = pd.DataFrame(rows, columns=["rep", "component", "shingles"])
    assert m.compared(80)(group).to_numpy().tolist() == [[3, 2]]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == root(x) for x in parent)
