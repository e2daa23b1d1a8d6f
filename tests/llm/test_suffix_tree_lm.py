import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import suffix_tree_lm as lm


def words(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_scores_and_counts(docs):
    rows = [(i, "The cat sat on the mat " * (i % 4) + "Ünï") for i in range(40)] + [(100, None), (101, ""), (102, "x " * 30_000), (103, "new words only"), (None, "the cat"), (7, "the cat")]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    got = lm.lm_score(docs(rows), ~held).collect()
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    wanted = sorted((str(d), len(w := words(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == wanted
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_context_beats_base_on_held_out_text(docs):
    rows = [(i, "alpha beta gamma delta epsilon zeta") for i in range(80)] + [(1000, "alpha beta gamma delta epsilon zeta")]
    got = {r.doc_id: r for r in lm.lm_score(docs(rows), F.col("doc_id") < 1000, strictness=1.0).collect()}
    assert got[1000].score > got[1000].base_score + 3


def brute(rows, train, depth=3, least=2, discount=0.75, strictness=2.0):
    """log10 probability of each text, word by word, with the tree as dictionaries of pasts; and sums of distributions."""
    texts = [words(t) for _, t in rows]
    learnt = [w for w, (d, _) in zip(texts, rows) if train(d)]
    c = collections.Counter(x for w in learnt for x in w)
    n, v = sum(c.values()), len(c)
    known = {x for x in c if c[x] >= least} | {b""}
    follow = collections.defaultdict(collections.Counter)
    for w in learnt:
        past = [b"", *w]
        for i in range(len(w)):
            for k in range(1, depth + 1):
                if i - k + 1 >= 0:
                    follow[tuple(past[i - k + 1 : i + 1])][w[i]] += 1

    def candidate(past):
        if len(past) == 1:
            return past[0] in known
        return candidate(past[:-1]) and past[-1] in known and follow[past[:-1]][past[-1]] >= least

    states = {}

    def probability(past, x):
        """In the longest state that is a suffix of past."""
        if not past:
            return (c[x] + 0.5) / (n + 0.5 * (v + 1))
        shorter = probability(past[1:], x)
        if not candidate(past) or not state(past):
            return shorter
        total, entries = states[past]
        mass = total - sum(k - discount for k in entries.values())
        return ((entries[x] - discount if x in entries else 0.0) + mass * shorter) / total

    def state(past):
        if past not in states:
            total = sum(follow[past].values())
            entries = {x: k for x, k in follow[past].items() if k >= least and x in known}
            states[past] = None
            if entries:
                likely = {x: lm.coarse(np.array([probability(past[1:], x)])).item() for x in entries}
                gain = sum(k * math.log(k / total / likely[x]) for x, k in entries.items())
                rest = total - sum(entries.values())
                if rest:
                    gain += rest * math.log(rest / total / max(1 - sum(likely.values()), 1e-12))
                if gain > strictness * math.log(max(n, 2)):
                    states[past] = (total, entries)
        return states[past]

    out = []
    for w in texts:
        past = [b"", *w]
        out.append(sum(math.log10(probability(tuple(past[max(0, i - depth + 1) : i + 1]), w[i])) for i in range(len(w))))
    unheard = {p[-depth:] for p in list(follow)[:50]}
    return out, [sum(probability(past, x) for x in [*c, None]) for past in unheard]


def corpus():
    rng = np.random.default_rng(5)
    lines = ["the cat sat on the mat and the dog sat on the log", "A cat and a dog met the Cat", "on the mat the cat met a dog"]
    rows = [(i, " ".join(lines[k] for k in rng.integers(0, 3, 4)) + f" only{i}") for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "unheard words the cat sat"), (103, "the " * 300), (None, lines[0]), (5, lines[1])]


@pytest.mark.parametrize("split, strictness", [(1 << 23, 0.5), (20, 0.5), (1 << 23, 2.0), (1 << 23, 1.9)])
def test_scores_against_brute_force(docs, split, strictness):
    """Also where the followers of most contexts are dealt to several parts, and where contexts of two occurrences are left out."""
    rows = corpus()
    got = lm.lm_score(docs(rows), F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True)), strictness=strictness, split=split).collect()
    wanted, sums = brute(rows, lambda d: d is None or d % 4 != 1, strictness=strictness)
    assert max(abs(x - 1) for x in sums) < 1e-9
    assert sorted((str(d), round(x, 5)) for (d, _), x in zip(rows, wanted)) == sorted((str(r.doc_id), round(r.score, 5)) for r in got)
    assert sum(r.score > r.base_score + 3 for r in got) > 50


def test_one_block_learns_what_another_is_scored_by(docs):
    """Contexts trained in one block only are states for held-out texts of others too."""
    rows = [*corpus(), (204, "alpha beta gamma delta " * 12), *((k, "alpha beta gamma delta alpha beta") for k in range(205, 285, 4))]
    got = lm.lm_score(docs(rows, 9), F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True)), strictness=0.5).collect()
    wanted, _ = brute(rows, lambda d: d is None or d % 4 != 1, strictness=0.5)
    assert sorted((str(d), round(x, 5)) for (d, _), x in zip(rows, wanted)) == sorted((str(r.doc_id), round(r.score, 5)) for r in got)


def test_nothing_to_learn_from(docs):
    got = lm.lm_score(docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm.lm_score(docs([]), F.lit(True)).count() == 0


def test_rare_contexts_count_in_a_large_corpus(docs):
    """Six occurrences are enough among 400,000 tokens: the tree grows with the corpus."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 2000))) for i in range(200)]
    rows += [(1000 + i, "alpha beta gamma delta epsilon zeta") for i in range(7)]
    got = {r.doc_id: r for r in lm.lm_score(docs(rows), F.col("doc_id") < 1006).collect()}
    assert got[1006].train_tokens > 400_000 and got[1006].score > got[1006].base_score + 3


def test_contexts_of_few_words_travel_in_less_than_hashes():
    """Bytes that a block of 400,000 tokens sends at the first two depths, and that what arrives is what was sent."""
    rng = np.random.default_rng(2)
    symbol = np.minimum(rng.zipf(1.3, 400_000) - 1, 40_000)
    c = np.bincount(symbol, minlength=40_001)
    first = np.arange(len(symbol)) % 300 == 0
    word = np.arange(len(c)).astype(np.uint64) * np.uint64(51) + rng.integers(0, 51, len(c)).astype(np.uint64)
    rule = lm.Rule(2, 0.75, 2.0, len(symbol))
    block = lm.planted(symbol, first, np.ones(len(symbol), bool), word, 5 * c, np.zeros(len(c), bool), 0, ((c + 0.5) / len(symbol))[symbol], rule.fewest)
    for most in (3.4, 4.7):
        q = lm.question(block, 50, 1 << 23)
        size, replies, spelled = 0, {}, block.spelled
        for part, *values in lm.sent(block, q):
            some = q.part == part
            assert (lm.named(values[0], values[2], spelled) == q.key[some]).all()
            sent = q.pairs()[0][np.repeat(some, q.pairs()[1])]
            assert (lm.climbed(values[5], lm.begins(values[4])) == word[q.symbol[sent]]).all()
            assert (lm.lengthened(values[7], word[q.symbol[sent]], values[6], len(block.path)) == lm.coarse(block.p[q.token[sent]])).all()
            size += sum(len(lm.pressed(x)) for v in values for x in (v if isinstance(v, list) else [v]))
            replies[part] = 8 * q.n[sent], np.zeros(some.sum()), np.zeros((some.sum(), 4))
        assert size < most * (q.row >= 0).sum()
        lm.deepened(block, q, replies, rule)
