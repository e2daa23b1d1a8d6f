"""Documents as blocks of word numbers: each distinct word of a block is held once.

A block is up to BLOCK_BYTES of text. Exploding a corpus into one row for each word would move more than the corpus; a
block moves each of its distinct words once, and everything that is looked up for a word comes back to the block as an
array by word number.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import trimmed, written_by

#: Text in a block; a longer document is a block of its own.
BLOCK_BYTES = 6 << 20

SCHEMA = "block long, words array<binary>, counts array<long>, doc_ids array<long>, marks array<boolean>, sizes array<int>, at binary"


class Numbers(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def packed(numbers: np.ndarray) -> bytes:
    """Word numbers as bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def numbered(split: Callable[[str], list]) -> Callable[[list[str]], tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Texts -> distinct words, the numbers of all words, words of each text; split gives text -> words."""

    def number(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        table, at = Numbers(), []
        for text in texts:
            words = split(text)
            at.append(np.fromiter(map(table.__getitem__, words), np.uint32, len(words)))
        return pa.array(list(table), pa.binary()), np.concatenate(at), np.array([len(x) for x in at], np.int64)

    return number


def _block(number: int, found: tuple[pa.Array, np.ndarray, np.ndarray], ids: list, marks: list) -> pa.RecordBatch:
    words, flat, sizes = found
    counts = np.bincount(flat, minlength=len(words))
    order = np.argsort(-counts, kind="stable")  # small numbers for frequent words
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    marked = counts if all(marks) else np.bincount(flat[np.repeat(np.array(marks, bool), sizes)], minlength=len(words))
    columns = [
        pa.array([number], pa.int64()),
        pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), words.take(pa.array(order))),
        pa.ListArray.from_arrays(pa.array([0, len(marked)], pa.int32()), pa.array(marked[order], pa.int64())),
        pa.array([ids], pa.list_(pa.int64())),
        pa.array([marks], pa.list_(pa.bool_())),
        pa.array([sizes], pa.list_(pa.int32())),
        pa.array([packed(place[flat])], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "words", "counts", "doc_ids", "marks", "sizes", "at"])


def to_blocks(docs: DataFrame, splitter: Callable[[], Callable[[list[str]], tuple]], name: str, block_bytes: int = BLOCK_BYTES, path: str | None = None) -> DataFrame:
    """Blocks of docs(doc_id, text, mark), bucketed by block. splitter() is called in the worker, see numbered().

    counts has each word's occurrences in marked documents. A null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_all = splitter()
        number = TaskContext.get().partitionId() << 32
        ids, marks, texts, used = [], [], [], 0

        def block() -> pa.RecordBatch:
            found = number_all(texts)
            texts.clear()
            return _block(number, found, ids, marks)

        for batch in batches:
            for doc_id, text, mark in zip(batch[0].to_pylist(), batch[1], batch[2].to_pylist()):
                text = text.as_py() or ""
                if ids and used + len(text) > block_bytes:
                    yield block()
                    number, ids, marks, used = number + 1, [], [], 0
                texts.append(text)
                ids.append(doc_id)
                marks.append(mark)
                used += len(text)
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("mark", F.lit(False)).alias("mark"))
    return written_by(rows.mapInArrow(trimmed(run), SCHEMA), name, "block", path)


def dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """Words of all blocks dealt to parts by their hash, so that all blocks' rows of a word meet in one task.

    One row for each part and block: part, block, nos, words, counts, packed (see opened()).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = batch[1][i].values, batch[2][i].values.to_numpy(zero_copy_only=False)
                part = (np.fromiter(map(zlib.crc32, words.to_pylist()), np.uint32, len(words)) % parts).astype(np.uint16 if parts < 1 << 16 else np.uint32)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(ends)).tolist()
                own = [order[ends[k] : ends[k + 1]] for k in some]
                bounds = pa.array(np.append(ends[some], len(order)), pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(bounds, words.take(pa.array(order))), b"\n")
                press = zstandard.ZstdCompressor(level=3).compress
                columns = [
                    pa.array(some, pa.int32()),
                    pa.array([batch[0][i].as_py()] * len(some), pa.int64()),
                    pa.array([packed(np.diff(x, prepend=0)) for x in own], pa.binary()),  # rising numbers, as differences
                    pa.array([press(x.as_buffer()) for x in joined], pa.binary()),
                    pa.array([packed(counts[x]) for x in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "nos", "words", "counts"])

    rows = blocks.select("block", "words", "counts").mapInArrow(trimmed(run), "part int, block long, nos binary, words binary, counts binary")
    return rows.repartition(parts, "part")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, list[bytes], np.ndarray]]:
    """Rows of dealt(): part, block, the packed numbers, the words and their counts."""
    for batch in batches:
        for part, block, nos, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
            yield part, block, nos, zstandard.ZstdDecompressor().decompress(words).split(b"\n"), unpacked(counts)


def by_document(sizes: np.ndarray) -> np.ndarray:
    """Where each document of a block begins and the last one ends."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
