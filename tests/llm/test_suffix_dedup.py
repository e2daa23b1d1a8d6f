import random

import numpy as np
import pytest

from larkspur.llm import suffix_dedup as s


def brute(rows, length):
    count = {}
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for (d, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((d, len(b), [(int(a), int(z)) for a, z in zip(edges[::2], edges[1::2])], bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def cases():
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    shared, other = text(90), text(70)
    rows = [(i, text(rng.randrange(0, 60)) + (shared[rng.randrange(0, 30) :] if i % 2 else other[: rng.randrange(30, 70)]) + text(rng.randrange(0, 60))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "ab" * 200), (104, "z" * 300), (105, shared + shared), (106, rows[3][1]), (107, rows[3][1]), (108, "\0" * 50 + text(30)), (109, text(20) + "\0" * 45)]
    rows += [(200, text(120))] * 2 + [(None, rows[5][1]), (201, "x" + shared[:40]), (202, shared[:40] + "\0")]
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_brute_force(docs, hot):
    rows = cases()
    assert got(s.remove_repeats(docs(rows), 40, hot)) == brute(rows, 40)


@pytest.mark.parametrize("digest_bytes", [1, 2])
def test_wrong_digests_are_found_out(docs, digest_bytes):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdé ") for _ in range(60))
    rows = cases() + [(1000 + i, "".join(rng.choice("abc") for _ in range(30)) + shared + "".join(rng.choice("abc") for _ in range(30))) for i in range(60)]
    assert got(s.remove_repeats(docs(rows), 40, digest_bytes=digest_bytes)) == brute(rows, 40)


def test_bytes_are_compared(spark):
    docs = spark.createDataFrame([(1, 11, "x" * 3000 + "abcdef"), (2, 22, "x" * 3000 + "abcdeg"), (3, 33, "--" + "x" * 3000 + "abcdef")], "id long, th long, text string")
    schema = "id long, th long, first int, last int, r_id long, r_th long, r_first int, r_last int"
    own = (1, 11, 5, 2606, 1, 11, 5, 2606)

    def wrong(*rows):
        return s.differ(spark.createDataFrame([own, *rows], schema), docs, 400)

    assert not wrong((3, 33, 7, 2608, 1, 11, 5, 2606))
    assert not wrong((2, 22, 5, 2605, 1, 11, 5, 2605))
    assert wrong((2, 22, 5, 2606, 1, 11, 5, 2606))
    assert wrong((3, 33, 6, 2607, 1, 11, 5, 2606))
    assert wrong((3, 33, 7, 2607, 1, 11, 5, 2606))
    assert wrong((3, 33, 7, 2608, 2, 22, 5, 2606))


#: 208 bytes that two different texts share; see below.
PREFIX = "vqzwxqjymlfjqfzibyzrpnnrmpuefpitvxxzvulwzoekctakjmpedcnjtcpecuaboklxemkmkprreohxmnhmptlrnyocuwdymwvdxmmghjcsjxagpofakgrsbgirnkyypuiukkvgblwheouzfgwcjfulhugvrnsfigypvhwpwvkglrwfzljukawcsmvtejdnlcuvwbttehmknjnx"


def test_texts_of_equal_polynomial_hashes_stay_whole(docs):
    """Thue-Morse words defeat every hash by a polynomial modulo 2**64."""
    x, y = "rxxnum", "kmduql"
    for _ in range(5):
        x, y = x + y, y + x
    rows = [(1, PREFIX + x), (2, PREFIX + y), (3, "z" + PREFIX + y + "z")]
    assert got(s.remove_repeats(docs(rows))) == brute(rows, 400)
    assert [len(r[1].encode()) for r in rows[:2]] == [400, 400]


def test_texts_longer_than_a_segment(docs):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh é") for _ in range(5000))
    text = rng.randbytes(3_300_000).hex()
    size = s.SEGMENT
    long = text[: size - 700] + shared[:1200] + text[size - 700 : size + 1_000_000] + shared + text[size + 1_000_000 :]
    rows = [(1, long), (2, shared[300:900]), (3, long[-2000:] + "!"), (4, shared)]
    assert len(long) > size + 2_000_000
    found = got(s.remove_repeats(docs(rows)))
    seen, twice = set(), set()
    texts = {d: t.encode() for d, t in rows}
    for b in texts.values():
        for h in (hash(b[i : i + 400]) for i in range(len(b) - 399)):
            (twice if h in seen else seen).add(h)
    for d, n, spans, kept in found:
        b, gone = texts[d], np.zeros(n, np.int64)
        for i in range(n - 399):
            if hash(b[i : i + 400]) in twice:
                gone[i : i + 400] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        assert spans == list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        assert kept == np.frombuffer(b, np.uint8)[gone == 0].tobytes()


def test_anchors_share_out_all_windows():
    texts = [(t or "").encode() for _, t in cases()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    text, at, low, high, g = s.anchors(data, starts, ends, 40)
    assert (high >= low).all() and (at >= low).all() and (high + 40 <= ends[text]).all()
    assert sum(int(h - lo) + 1 for lo, h in zip(low, high)) == sum(max(len(t) - 39, 0) for t in texts)


def test_the_query_against_brute_force(spark, sf_dir):
    import hashlib

    from larkspur.llm.queries import op2_suffix_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    wanted = sorted((d, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in brute(rows, 400))
    assert sorted(map(tuple, op2_suffix_dedup(spark, sf_dir).collect())) == wanted
    assert any(r[2] for r in wanted)


def test_empty(docs):
    assert s.remove_repeats(docs([]), 40).count() == 0


def test_multikey_sort_and_prefixes():
    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    keys = s.tokens(parts, 24)
    order, common = s.multikey_sort(keys)
    padded = [parts[i][:24].ljust(24, b"\0") for i in order]
    assert padded == sorted(padded)
    for i in range(1, len(padded)):
        n = next((k for k in range(24) if padded[i][k] != padded[i - 1][k]), 24)
        assert common[i] == n


def test_window_minima():
    keys = np.random.default_rng(0).integers(0, 99, 500).astype(np.uint64)
    for w in (1, 2, 7, 500):
        assert (s.window_minima(keys, w) == np.lib.stride_tricks.sliding_window_view(keys, w).min(axis=1)).all()
