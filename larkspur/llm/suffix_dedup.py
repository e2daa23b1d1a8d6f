"""Removal of repeated byte strings with a sparse suffix array over range-partitioned buckets.

Sorting every suffix of a corpus would move it hundreds of times over. A string of `length` bytes that occurs twice has
the same smallest gram of `length // 2` bytes in both places, so only suffixes that start at such an anchor are kept:
about one in a hundred, and of those only the ones whose gram occurs again. Each window of `length` bytes belongs to
one anchor, and an anchor's windows are consecutive.

Copies of one context (all bytes of all of an anchor's windows) collapse to one representative by a keyed digest, so copies of
any number cost one aggregated row. The representatives are the suffixes to sort: sampled splitters range-partition them
by their leading tokens and their gram, a bucket sorts its suffixes by multikey quicksort on 8-byte
tokens, and their left contexts likewise. Neighbours' common prefixes then tell for each offset which windows are equal.
Suffixes with the same gram always share a bucket, so there is nothing to compare across a boundary; a gram with more distinct
contexts than a bucket may hold is counted window by window across the cluster, by keyed digests too.

Nothing is removed on the word of a digest. Whatever was taken for a copy is compared with its representative byte by byte:
neighbouring windows with one representative make one run, runs are cut at the pages of the representative's text, and
pieces meet pages in a join. If any piece differs the job is done again with another key and longer digests.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import key_bits, maybe_flag, maybe_in, trimmed, written

#: Bytes that are hashed together; longer texts come in overlapping segments.
BUFFER = 1 << 18
SEGMENT = 1 << 22

#: Leading bytes of a suffix, four tokens, by which buckets are split.
LEADING = 32

#: Bytes of the contexts of a bucket on average, and distinct contexts of one gram that share a bucket at most.
BUCKET, HOT = 16 << 20, 20_000

#: Pages of texts that copies are compared with.
PAGE = 2048

_RNG = np.random.default_rng(23)
_TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 40, 1 << 63)) | 1


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            more = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, more, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, more, 1 << 64))])


_POWERS = Powers(_BASE)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all grams of so many bytes. They choose anchors and group them; equality of grams does not rest on them."""
    n = len(data) - size + 1
    _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _POWERS.down[: len(data)], out=sums[1:])
    return (sums[size:] - sums[:n]) * _POWERS.up[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: of a block's prefix and the suffix of the one before."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the texts data[starts[i]:ends[i]]: text, anchor, first and last window, gram hash."""
    k = length // 2
    w = length - k + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    grams = gram_hashes(data, k)
    keys = (mixed(grams) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (window_minima(keys, w) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
    inside = np.arange(len(at)) + length <= ends[text]
    windows = np.flatnonzero(inside)
    if not len(windows):
        return none, none, none, none, none.astype(np.uint64)
    a, t = at[windows], text[windows]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]))
    low, high = windows[new], windows[np.concatenate([new[1:], [len(windows)]]) - 1]
    return t[new], a[new], low, high, grams[a[new]]


def all_anchors(docs: DataFrame, length: int, key: bytes, digest_bytes: int) -> DataFrame:
    """(id, th, at, low, high, g, c) of docs(id, th, text): c is the keyed digest of an anchor's context."""
    schema = "id long, th long, at int, low int, high int, g long, c binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        used = 0
        digest = hashlib.blake2b

        def flushed() -> pa.RecordBatch:
            sizes = np.array([len(x[3]) for x in held], np.int64)
            ends = np.cumsum(sizes)
            data = b"".join(x[3] for x in held)
            t, *found, g = anchors(np.frombuffer(data, np.uint8), ends - sizes, ends, length)
            c = [digest(data[a:b], digest_size=digest_bytes, key=key).digest() for a, b in zip(found[1].tolist(), (found[2] + length).tolist())]
            ids, th = (np.array([x[i] for x in held], np.int64)[t] for i in range(2))
            shift = (np.array([x[2] for x in held], np.int64) - (ends - sizes))[t]
            columns = [pa.array(ids), pa.array(th), *(pa.array((x + shift).astype(np.int32)) for x in found), pa.array(g.view(np.int64)), pa.array(c, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "th", "at", "low", "high", "g", "c"])

        for batch in batches:
            for id_, th, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2]):
                data = text.as_py().encode()
                for s in range(0, max(len(data) - length + 1, 0), SEGMENT):
                    part = data[s : s + SEGMENT + length - 1]
                    held.append((id_, th, s, part))
                    used += len(part)
                    if used >= BUFFER:
                        yield flushed()
                        held.clear()
                        used = 0
        if held:
            yield flushed()

    return docs.select("id", "th", "text").mapInArrow(trimmed(run), schema)


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 8-byte tokens and the common prefix, in bytes, of each sorted row with the one before.

    Multikey quicksort with all partitions of a depth handled together: rows are sorted by one token within their
    partition, and only those that are still equal go on to the next token. Row 0's prefix is 0; equal rows share all.
    """
    n, m = keys.shape
    order = np.arange(n)
    common = np.full(n, 8 * m, np.int64)
    if n:
        common[0] = 0
    open_ = np.arange(n)  # sorted places that are not yet settled
    group = np.zeros(n, np.int64)  # their partitions
    for depth in range(m):
        if not len(open_):
            break
        token = keys[order[open_], depth]
        by = np.lexsort((token, group))
        order[open_] = order[open_[by]]
        token, group = token[by], group[by]
        same_group = np.concatenate([[False], group[1:] == group[:-1]])
        differs = np.concatenate([[0], token[1:] ^ token[:-1]]).astype(np.uint64)
        splits = same_group & (differs != 0)
        bits = differs[splits].astype(np.float64)
        # bytes before the highest set bit; float rounding up to a power of two is undone by comparing
        high = np.floor(np.log2(bits)).astype(np.int64)
        high = np.where((high > 63) | ((differs[splits] >> np.minimum(high, 63).astype(np.uint64)) == 0), high - 1, high)
        common[open_[splits]] = 8 * depth + (63 - high) // 8
        group = np.cumsum(~same_group | splits) - 1
        alone = np.bincount(group)[group] == 1
        open_, group = open_[~alone], group[~alone]
    return order, common


def tokens(parts: list[bytes], size: int) -> np.ndarray:
    """Rows of big-endian 8-byte tokens, padded with zeros."""
    width = -(-size // 8) * 8
    return np.frombuffer(b"".join(p[:size].ljust(width, b"\0") for p in parts), ">u8").reshape(len(parts), -1).astype(np.uint64)


def repeated_windows(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """(contexts, offsets) booleans: whether the window that starts offset bytes before the anchor occurs again.

    left and right: bytes before and from the anchor; low, high: smallest and largest offset of each context's windows.
    """
    n, most = len(left), int(high.max(initial=0))
    out = np.zeros((n, most + 1), bool)
    r_order, r_common = multikey_sort(tokens(right, length))
    l_order, l_common = multikey_sort(tokens([x[::-1] for x in left], max(most, 1)))
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(low.min(initial=0)), most + 1):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < length - d)
        l_class[l_order] = np.cumsum(l_common < d)
        both = r_class[rows] * (n + 1) + l_class[rows]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        out[rows[order[again]], d] = True
    return out


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def cut_contexts(rows: DataFrame, length: int) -> DataFrame:
    """Bytes around the anchors of rows(id, th, text, anchors)."""
    names = ["id", "th", "at", "low", "high", "g", "hot", "single", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, th, text, found in zip(*(batch[i] for i in range(4))):
                data, found = text.as_py().encode(), found.as_py()
                for s in range(0, len(found), 4096):
                    some = found[s : s + 4096]
                    n = len(some)
                    columns = [pa.array([id_.as_py()] * n, pa.int64()), pa.array([th.as_py()] * n, pa.int64())]
                    columns += [pa.array([x[k] for x in some], t) for k, t in (("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("g", pa.int64()), ("hot", pa.bool_()), ("single", pa.bool_()))]
                    columns += [pa.array([data[x["low"] : x["at"]] for x in some], pa.binary()), pa.array([data[x["at"] : x["high"] + length] for x in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("id", "th", "text", "anchors").mapInArrow(trimmed(run), "id long, th long, at int, low int, high int, g long, hot boolean, single boolean, left binary, right binary")


def sorted_buckets(contexts: DataFrame, length: int, bucket: int = BUCKET) -> DataFrame:
    """(id, th, first, last): runs of repeated windows, from range-partitioned buckets of suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        table = pa.Table.from_batches(rows)
        at, low, high = (table[k].to_numpy() for k in ("at", "low", "high"))
        again = repeated_windows(table["left"].to_pylist(), table["right"].to_pylist(), at - high, at - low, length)
        again &= table["single"].to_numpy()[:, None]
        row, first, last = runs(again)
        ids, th = table["id"].combine_chunks().take(pa.array(row)), table["th"].combine_chunks().take(pa.array(row))
        yield pa.RecordBatch.from_arrays([ids, th, pa.array((at[row] - last).astype(np.int32)), pa.array((at[row] - first).astype(np.int32))], names=["id", "th", "first", "last"])

    columns = ["id", "th", "at", "low", "high", "single", "left", "right"]
    size = contexts.agg(F.sum(F.octet_length("left") + F.octet_length("right"))).first()[0] or 0
    parts = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket))
    # sampled splitters deal the suffixes out by leading tokens, those with equal ones by gram; a gram is never split, since equal keys stay together
    by_range = contexts.select(*columns, "g").repartitionByRange(parts, F.substring("right", 1, min(LEADING, length // 2)), "g").drop("g")
    return by_range.mapInArrow(trimmed(run), "id long, th long, first int, last int")


def counted_windows(contexts: DataFrame, length: int, key: bytes, digest_bytes: int) -> DataFrame:
    """Repeated windows of grams with too many contexts, as copies of a representative: (id, th, first, last, r_id, r_th, r_first, r_last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, th, low, high, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                data, n = left + right, high - low + 1
                digests = [hashlib.blake2b(data[i : i + length], digest_size=digest_bytes, key=key).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([id_] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(range(low, high + 1), pa.int32()), pa.array(digests, pa.binary())], names=["id", "th", "first", "digest"])

    windows = contexts.select("id", "th", "low", "high", "left", "right").mapInArrow(run, "id long, th long, first int, digest binary")
    windows = written(windows, "windows")
    again = windows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "first")).alias("one")).where("n > 1").drop("n")
    again = written(again, "again")  # a plain side, which AQE can split where a window is hot
    return windows.join(again.hint("merge"), "digest").select("id", "th", "first", F.col("first").alias("last"), F.col("one.id").alias("r_id"), F.col("one.th").alias("r_th"), F.col("one.first").alias("r_first"), F.col("one.first").alias("r_last"))


def pieces(rows: DataFrame, length: int) -> DataFrame:
    """Copies' bytes by page of their representatives, and those pages: (r_id, r_th, page, begin, data, page_data).

    rows: (id, th, text, copies), copies being structs (first, last, r_id, r_th, r_first).
    """
    names = ["r_id", "r_th", "page", "begin", "data", "page_data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [t.as_py().encode() for t in part[2]]
                flat = part[3].flatten()
                doc = np.repeat(np.arange(part.num_rows), part[3].value_lengths().to_numpy())
                first, last, r_id, r_th, r_first = (flat.field(i).to_numpy().astype(np.int64) for i in range(5))
                own_id, own_th = part[0].to_numpy()[doc], part[1].to_numpy()[doc]
                own = (r_id == own_id) & (r_th == own_th) & (r_first == first)
                shift = r_first - first
                order = np.lexsort((first, shift, r_th, r_id, doc))
                doc, first, last, r_id, r_th, shift, own = (x[order] for x in (doc, first, last, r_id, r_th, shift, own))
                # neighbours that touch in both texts are one run
                split = (np.diff(doc) != 0) | (np.diff(r_id) != 0) | (np.diff(r_th) != 0) | (np.diff(shift) != 0) | (first[1:] > last[:-1] + length)
                new = np.flatnonzero(np.concatenate([[True], split])) if len(doc) else np.zeros(0, np.int64)
                ends = np.maximum.reduceat(last, new) + length if len(new) else new
                out = []
                for d, x, y, move, i, h, mine in zip(*(v.tolist() for v in (doc[new], first[new], ends, shift[new], r_id[new], r_th[new], own[new]))):
                    for page in range((x + move) // PAGE, (y + move - 1) // PAGE + 1):
                        if mine:
                            out.append((i, h, page, None, None, texts[d][page * PAGE : (page + 1) * PAGE]))
                        else:
                            begin, end = max(x + move, page * PAGE), min(y + move, (page + 1) * PAGE)
                            out.append((i, h, page, begin - page * PAGE, texts[d][begin - move : end - move], None))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    return rows.select("id", "th", "text", "copies").mapInArrow(trimmed(run), "r_id long, r_th long, page int, begin int, data binary, page_data binary")


def differ(copies: DataFrame, docs: DataFrame, length: int) -> bool:
    """Whether any of copies(id, th, first, last, r_id, r_th, r_first, r_last) is not what its representative is, byte by byte."""
    if copies.agg(F.count_if(F.expr("last - first <> r_last - r_first"))).first()[0]:
        return True
    asked = copies.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last", "r_id", "r_th", "r_first")).alias("copies"))
    asked = written(asked, "asked")
    texts = maybe_in(docs.select("id", "th", "text"), "th", key_bits(asked, "th")).dropDuplicates(["id", "th"])
    cut = written(pieces(texts.join(asked.hint("merge"), ["id", "th"]), length), "pieces")
    # a representative's runs may share a page
    pages = cut.where("page_data is not null").groupBy("r_id", "r_th", "page").agg(F.first("page_data").alias("page_data"))
    pages = written(pages, "pages")
    met = cut.where("data is not null").drop("page_data").join(pages.hint("merge"), ["r_id", "r_th", "page"], "left")
    return met.agg(F.count_if(F.expr("not (substring(page_data, begin + 1, octet_length(data)) <=> data)"))).first()[0] > 0


def repeated_runs(docs: DataFrame, length: int, hot: int, digest_bytes: int) -> DataFrame | None:
    """(id, th, repeats) of docs(id, th, text), repeats being structs (first, last) of windows; None if digests were wrong."""
    key = os.urandom(32)
    found = written(all_anchors(docs, length, key, digest_bytes), "anchors")
    # written, so that the join's two sides are plain exchanges and AQE can split a gram that very many places share
    again = written(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "grams")
    found = written(found.join(again.hint("merge"), "g"), "repeated")
    contexts = written(found.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at", "low", "high")).alias("one")), "contexts")
    same = contexts.where("n > 1").select("g", "c", F.col("one.id").alias("r_id"), F.col("one.th").alias("r_th"), F.col("one.low").alias("r_first"), F.col("one.high").alias("r_last"))
    settled = found.join(same.hint("merge"), ["g", "c"]).select("id", "th", F.col("low").alias("first"), F.col("high").alias("last"), "r_id", "r_th", "r_first", "r_last")
    mixed_ = contexts.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("g", (F.col("m") > hot).alias("hot"))
    open_ = contexts.join(mixed_.hint("merge"), "g").select("one.*", "g", "hot", (F.col("n") == 1).alias("single"))
    open_ = written(open_.groupBy("id", "th").agg(F.collect_list(F.struct("at", "low", "high", "g", "hot", "single")).alias("anchors")), "open")
    texts = maybe_in(docs.select("id", "th", "text"), "th", key_bits(open_, "th")).dropDuplicates(["id", "th"])
    cut = written(cut_contexts(texts.join(open_.hint("merge"), ["id", "th"]), length), "cut")
    copies = written(settled.union(counted_windows(cut.where("hot"), length, key, digest_bytes)), "copies")
    if differ(copies, docs, length):
        return None
    repeats = copies.select("id", "th", "first", "last").union(sorted_buckets(cut.where("not hot"), length))
    return written(repeats.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("repeats")), "spans")


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = HOT, digest_bytes: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (array of start, end), kept (binary).

    Every byte covered by a string of `length` bytes that also starts anywhere else is removed: in another text, in
    another row with the same text, or elsewhere in its own text, overlaps included. spans are the maximal removed runs
    in bytes of the UTF-8 text, kept the other bytes. A null text counts as empty; texts shorter than `length` lose
    nothing; texts of any length are read whole, in overlapping segments; an empty table gives an empty result. Rows that
    repeat doc_id and text share one result; a null doc_id is an id like any other. Other columns are
    ignored. length is at least 16. digest_bytes: size of the digests that propose copies, doubled when the byte check fails.
    """
    # the seed keeps th from being foreseen; a row without doc_id is told from any with one
    seed = int.from_bytes(os.urandom(7))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "text").alias("th"), "text")
    while (spans := repeated_runs(docs, length, hot, digest_bytes)) is None:
        digest_bytes = min(2 * digest_bytes, 64)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                out = []
                for text, repeats in zip(part[1], part[2]):
                    data = np.frombuffer(text.as_py().encode(), np.uint8)
                    edges = np.zeros(len(data) + 1, np.int64)
                    for r in repeats.as_py() or ():
                        edges[r["first"]] += 1
                        edges[r["last"] + length] -= 1
                    gone = np.cumsum(edges[:-1]) > 0
                    row, first, last = runs(gone[None, :])
                    out.append((len(data), [{"start": int(x), "end": int(y) + 1} for x, y in zip(first, last)], data[~gone].tobytes()))
                kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
                yield pa.RecordBatch.from_arrays([part[0], *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], names=["doc_id", "n_bytes", "spans", "kept"])

    flagged = maybe_flag(docs, "th", key_bits(spans, "th"), "maybe")
    clean = flagged.where("not maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    rest = flagged.where("maybe").join(spans.hint("merge"), ["id", "th"], "left").select("doc_id", "text", "repeats")
    return clean.union(rest.mapInArrow(trimmed(removed), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"))
