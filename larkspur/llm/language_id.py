"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows, one recurrent layer forwards and one backwards (softsign in place of tanh and
logistic function); both states of a
position give the probabilities of the languages there, and a document's probabilities are the mean over all its
positions. It is trained in numpy by backpropagation through time (Adam, cross-entropy at every position) on a bounded
sample of labelled documents, in a fixed order from a fixed seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from larkspur.llm.common import small_batches, trimmed

#: Bytes of a window, and the number that stands for no byte.
WINDOW, PAD = 128, 256

#: Windows that go through the network together.
BATCH = 4096

UNKNOWN = "und"


@dataclass
class Network:
    """Weights by direction: inputs (3h x 257, one column for each byte) and recurrence (3h x h), gates z, r, n."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.recurrent[0].shape[1]

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.output, self.bias]


def fresh(languages: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Network(languages, [normal(3 * hidden, PAD + 1, scale=0.5) for _ in range(2)], [normal(3 * hidden, hidden, scale=hidden**-0.5) for _ in range(2)], normal(len(languages), 2 * hidden, scale=0.5), np.zeros((len(languages), 1), np.float32))


def softsign(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: bounded like tanh at a fraction of its cost; its slope is (1 - |y|) squared."""
    np.abs(x, out=room)
    room += 1
    x /= room
    return x


def gate(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """(1 + softsign(x)) / 2 in place."""
    softsign(x, room)
    x += 1
    x *= 0.5
    return x


def run_layer(x: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, keep: bool = False):
    """States (t, h, b) of one direction over byte numbers x (t, b); with keep also the gates that training needs."""
    t, b = x.shape
    h3, h = recurrent.shape
    states = np.empty((t, h, b), np.float32)
    now = np.zeros((h, b), np.float32)
    a, g, room = (np.empty((h3, b), np.float32) for _ in range(3))
    saved = []
    for i in range(t):
        np.take(inputs, x[i], axis=1, out=g, mode="clip")
        np.matmul(recurrent, now, out=a)
        zr, n, inner = g[: 2 * h], g[2 * h :], a[2 * h :]
        zr += a[: 2 * h]
        gate(zr, room[: 2 * h])
        if keep:
            raw = inner.copy()
        inner *= zr[h:]
        n += inner
        softsign(n, room[2 * h :])
        if keep:
            saved.append((zr[:h].copy(), zr[h:].copy(), n.copy(), raw, now))
        new = states[i]
        np.subtract(now, n, out=new)
        new *= zr[:h]
        new += n
        now = new
    return (states, saved) if keep else states


def back_layer(x: np.ndarray, grad: np.ndarray, saved: list, inputs: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of inputs and recurrence from those of the states."""
    h = recurrent.shape[1]
    d_in, d_rec = np.zeros_like(inputs), np.zeros_like(recurrent)
    carry = np.zeros_like(grad[0])
    by_byte = np.zeros((inputs.shape[1], inputs.shape[0]), np.float32)
    for i in range(len(x) - 1, -1, -1):
        z, r, n, raw, before = saved[i]
        d = grad[i] + carry
        d_n = d * (1 - z) * (1 - np.abs(n)) ** 2
        d_z = d * (before - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_r = d_n * raw * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        gates = np.concatenate([d_z, d_r, d_n])
        np.add.at(by_byte, x[i], gates.T)
        gates[2 * h :] *= r
        d_rec += gates @ before.T
        carry = d * z + recurrent.T @ gates
    return by_byte.T, d_rec


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(t, languages, b) for byte numbers x (t, b)."""
    forward = run_layer(x, net.inputs[0], net.recurrent[0])
    backward = run_layer(x[::-1], net.inputs[1], net.recurrent[1])[::-1]
    h = net.hidden
    logits = np.matmul(net.output[:, :h], forward)
    logits += np.matmul(net.output[:, h:], backward)
    logits += net.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients in the order of weights(). x: (t, b) bytes, y: (b,) language, weight: (t, b) of positions."""
    h = net.hidden
    forward, kept_f = run_layer(x, net.inputs[0], net.recurrent[0], keep=True)
    backward, kept_b = run_layer(x[::-1], net.inputs[1], net.recurrent[1], keep=True)
    both = np.concatenate([forward, backward[::-1]], axis=1)
    logits = np.matmul(net.output, both) + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    column = np.arange(x.shape[1])
    loss = float(-(np.log(np.maximum(p[:, y, column], 1e-9)) * weight).sum())
    p[:, y, column] -= 1
    p *= weight[:, None, :]
    d_both = np.matmul(net.output.T, p)
    d_in0, d_rec0 = back_layer(x, d_both[:, :h], kept_f, net.inputs[0], net.recurrent[0])
    d_in1, d_rec1 = back_layer(x[::-1], d_both[::-1, h:], kept_b, net.inputs[1], net.recurrent[1])
    return loss, [d_in0, d_in1, d_rec0, d_rec1, np.einsum("tlb,thb->lh", p, both), p.sum(axis=(0, 2))[:, None]]


def train(windows: list[tuple[bytes, str]], hidden: int = 8, updates: int = 250, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network | None:
    """A network from (window of bytes, language) pairs; None without any."""
    languages = sorted({lang for _, lang in windows})
    if not languages:
        return None
    net = fresh(languages, hidden, seed)
    x = as_windows([w for w, _ in windows])[0]
    y = np.array([languages.index(lang) for _, lang in windows])
    shares = 1 / np.bincount(y)[y]
    rng = np.random.default_rng(seed)
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, updates + 1):
        rows = rng.choice(len(x), batch, p=shares / shares.sum())
        part = np.ascontiguousarray(x[rows].T)
        weight = (part != PAD).astype(np.float32)
        weight /= max(weight.sum(), 1)
        _, grads = gradients(net, part, y[rows], weight)
        now = rate * min(1.0, 2 * (1 - step / (updates + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def as_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) byte numbers of all texts, the last of each text padded, and each window's text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    x = np.full(int(counts.sum()) * WINDOW, PAD, np.intp)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = (np.cumsum(counts) - counts) * WINDOW
    x[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    return x.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): mean position probabilities over the whole of each text; zeros for an empty one.

    Long texts go through in pieces of whole windows, so memory does not grow with them.
    """
    sums = np.zeros((len(texts), len(net.languages)))
    pieces: list[bytes] = []
    owners: list[int] = []

    def add() -> None:
        x, piece = as_windows(pieces)
        owner = np.array(owners)[piece]
        for a in range(0, len(x), BATCH):
            part = np.ascontiguousarray(x[a : a + BATCH].T)
            p = position_probabilities(net, part)
            p *= (part != PAD)[:, None, :]
            np.add.at(sums, owner[a : a + BATCH], p.sum(axis=0).T)
        pieces.clear()
        owners.clear()

    used = 0
    for i, text in enumerate(texts):
        for a in range(0, len(text), BATCH * WINDOW):
            pieces.append(text[a : a + BATCH * WINDOW])
            owners.append(i)
            used += -(-len(pieces[-1]) // WINDOW)
            if used >= BATCH:
                add()
                used = 0
    if pieces:
        add()
    return sums / np.maximum([[len(t)] for t in texts], 1)


def sample_windows(docs: DataFrame, learn: Column, sample_docs: int, per_doc: int) -> list[tuple[bytes, str]]:
    """Windows of at most about sample_docs labelled documents, as many from each language, in the order of a hash."""
    rows = docs.select("doc_id", "text", "lang", F.xxhash64(F.lit(3), F.col("doc_id"), F.octet_length("text")).alias("order")).where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") > 0))
    keys = rows.select("lang", "order")
    langs = keys.select("lang").distinct().count()
    each = max(4, sample_docs // max(langs, 1))
    keys = keys.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("order"))).where(F.col("rank") <= each).select("order")
    chosen = [r[0] for r in keys.collect()]
    if not chosen:
        return []
    # of rows that repeat an id and length the smallest text, so that reruns agree
    rows = rows.where(F.col("order").isin(chosen)).groupBy("order", "lang").agg(F.min("text").alias("text")).select("order", "text", "lang")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for order, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                starts = sorted({int(s) for s in np.linspace(0, max(len(data) - WINDOW, 0), per_doc)})
                out += [(order, s, data[s : s + WINDOW], lang) for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.string()))], names=["order", "at", "data", "lang"])

    found = rows.mapInArrow(windows, "order long, at long, data binary, lang string").collect()
    return [(bytes(r["data"]), r["lang"]) for r in sorted(found, key=lambda r: (r["order"], r["lang"], r["at"]))]


def labelled(docs: DataFrame, learn: Column, sample_docs: int = 800, per_doc: int = 4, **training) -> DataFrame:
    """All rows and columns of docs with lang_pred and score (which replace columns of these names); see identify()."""
    spark = docs.sparkSession
    small_batches(spark)
    net = train(sample_windows(docs, learn, sample_docs, per_doc), **training)
    shared = spark.sparkContext.broadcast(net)  # a few 10 kB
    docs = docs.drop("lang_pred", "score")
    names_in = docs.columns
    where = names_in.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts, at = batch[where], 0
            while at < len(texts):
                part, used, begin = [], 0, at
                while at < len(texts) and (not part or used < 4 << 20):
                    part.append(texts[at].as_py() or "")
                    used += len(part[-1])
                    at += 1
                lettered = [any(map(str.isalpha, t)) for t in part]
                p = pooled(net, [t.encode() if ok else b"" for t, ok in zip(part, lettered)]) if net else np.zeros((len(part), 1))
                best = p.argmax(axis=1)
                names = [net.languages[k] if ok and net else UNKNOWN for k, ok in zip(best, lettered)]
                rows = batch.slice(begin, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(np.clip(p.max(axis=1), 0, 1), pa.float64())], names=[*names_in, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(trimmed(label), schema)


def identify(docs: DataFrame, learn: Column, **options) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    The network learns from text and non-null lang of the rows that learn marks, at most about sample_docs of them
    (4 of each language at least) with per_doc windows each; whole texts are labelled. lang_pred is the language with
    the largest pooled probability, the score; `und` with score 0 where the text is null or has no letter, or where
    there was nothing to learn from, and for empty texts. Ties go to the first language in code-point order. Rows that repeat
    a doc_id are labelled one by one; other columns are ignored; an empty table gives an empty result.
    """
    return labelled(docs.select(F.col("doc_id").cast("long"), "text", "lang"), learn, **options).select("doc_id", "lang_pred", "score")


def kept(docs: DataFrame, learn: Column, least: float, **options) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`, all columns as they were."""
    return labelled(docs, learn, **options).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
