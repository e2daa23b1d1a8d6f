import zlib

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import language_id as g


def test_backpropagation_equals_differences():
    net = g.fresh(["a", "b", "c"], 3, 1)
    rng = np.random.default_rng(0)
    x, y, weight = rng.integers(0, 6, (7, 5)), rng.integers(0, 3, 5), np.ones((7, 5), np.float32)
    _, grads = g.gradients(net, x, y, weight)
    for w, d in zip(net.weights(), grads):
        for _ in range(5):
            i = tuple(int(rng.integers(0, min(n, 6))) for n in w.shape)
            before = w[i]
            w[i] = before + 1e-2
            up, _ = g.gradients(net, x, y, weight)
            w[i] = before - 1e-2
            down, _ = g.gradients(net, x, y, weight)
            w[i] = before
            assert abs((up - down) / 2e-2 - d[i]) < 0.02 + 0.02 * abs(d[i])


def test_windows_hold_every_byte():
    texts = [b"", b"x", b"ab" * 200, b"z" * 128]
    x, owner = g.as_windows(texts)
    assert [bytes(x[owner == i].ravel()[: len(t)].astype(np.uint8)) for i, t in enumerate(texts)] == texts
    assert (x != g.PAD).sum() == sum(map(len, texts))


def test_batching_does_not_change_predictions():
    net = g.fresh(["a", "b"], 4, 2)
    texts = [b"hello world" * k for k in range(1, 9)]
    one = np.concatenate([g.pooled(net, [t]) for t in texts])
    assert np.allclose(g.pooled(net, texts), one, atol=1e-5) and np.allclose(one.sum(axis=1), 1, atol=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = {r.doc_id: r for r in g.identify(docs, ~out).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(found) == len(rows) and np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in found.values())


def test_odd_rows(docs):
    rows = [(1, "the cat and the dog " * 5, "en"), (2, "der hund und die katze " * 5, "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (None, "the dog", None), (6, "und die " * 30_000, None), (6, "the", "en")]
    frame = docs(rows)
    found = g.identify(frame, F.lit(True), updates=30).collect()
    by = {(r.doc_id, round(r.score, 6)): r.lang_pred for r in found}
    assert len(found) == len(rows) and by[3, 0.0] == by[4, 0.0] == by[5, 0.0] == "und"
    assert {r.lang_pred for r in found} <= {"en", "de", "und"}
    again = sorted((str(r) for r in g.identify(frame, F.lit(True), updates=30).collect()))
    assert again == sorted(str(r) for r in found)
    kept = g.kept(frame, F.lit(True), 0.0, updates=30)
    assert kept.columns == frame.columns and kept.count() == 5


def test_nothing_to_learn_from(docs):
    assert [(r.lang_pred, r.score) for r in g.identify(docs([(1, "text")]), F.lit(True)).collect()] == [("und", 0.0)]
    assert g.identify(docs([]), F.lit(True)).count() == 0


def test_long_texts_in_pieces():
    """Pieces change nothing: windows start anew at each multiple of their size anyway."""
    net = g.fresh(["a", "b", "c"], 4, 1)
    rng = np.random.default_rng(2)
    texts = [rng.integers(32, 126, n, dtype=np.uint8).tobytes() for n in (0, 5, g.WINDOW, 3000, 2 * g.BATCH * g.WINDOW + 77, 40)]
    got = g.pooled(net, texts)
    for text, p in zip(texts, got):
        x, _ = g.as_windows([text])
        wanted = np.zeros(3)
        for a in range(0, len(x), 1000):
            part = np.ascontiguousarray(x[a : a + 1000].T)
            wanted += (g.position_probabilities(net, part) * (part != g.PAD)[:, None, :]).sum(axis=(0, 2))
        assert np.allclose(p, wanted / max(len(text), 1), atol=1e-5)
