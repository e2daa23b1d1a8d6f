"""Byte-pair encoding and decoding by a table of distinct words.

Documents are split into words, each block of documents holds its distinct words once, and all occurrences of a word in
the blocks meet in one task, which encodes it once. The identifiers return to the blocks and are laid out by position.
Decoding joins identifiers to the pieces of the vocabulary.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.blocks import by_document, dealt, numbered, opened, packed, to_blocks, unpacked
from larkspur.llm.common import trimmed

#: Marks a special token among the words; no word holds a blank.
SPECIAL = b" "

#: Texts of these characters only are split without the library: they have one normal form and plain letters.
PLAIN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
PLAIN_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+")

#: The one splitting pattern for which PLAIN_WORDS stands.
PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_splitter(spec: str) -> Callable[[], Callable[[str], list[bytes]]]:
    """Text -> words as the tokenizer's own normaliser and splitting pattern make them, special tokens apart."""

    def make() -> Callable[[str], list[bytes]]:
        parts = json.loads(spec)
        del parts["model"]
        pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        library = []  # the tokenizer's own normaliser and splitter, loaded by the first text that needs them
        kinds = [n["type"] for n in parts["normalizer"]["normalizers"]]
        plain = pattern == PLAIN_FOR and kinds == ["NFC", "Replace", "Lowercase"]
        specials = [t["content"] for t in parts["added_tokens"]]
        around = re.compile("(" + "|".join(map(re.escape, specials)) + ")")

        def words(text: str) -> list[bytes]:
            if plain and not PLAIN.search(text):
                return PLAIN_WORDS.findall(text.lower())
            if not library:
                from tokenizers import Regex, Tokenizer, pre_tokenizers

                library[:] = Tokenizer.from_str(spec).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
            normaliser, splitter = library
            return [w for w, _ in splitter.pre_tokenize_str(normaliser.normalize_str(text))]

        def split(text: str) -> list:
            if "<" not in text or not around.search(text):
                return words(text)
            out = []
            for i, part in enumerate(around.split(text)):
                out += [SPECIAL.decode() + part] if i % 2 else words(part)
            return out

        return split

    return make


def vocabulary(spark: SparkSession, spec: str) -> DataFrame:
    """The id-to-piece table as one row of an array by id: as large as the tokenizer makes it, whatever the data."""
    parts = json.loads(spec)
    pieces = {i: p for p, i in parts["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parts["added_tokens"]}
    return spark.createDataFrame([(0, [pieces.get(i) for i in range(max(pieces) + 1)])], "page int, pieces array<string>")


def encode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, those of the tokenizers library without added special tokens.

    Null and empty texts give no ids; texts of any length are encoded whole, a long one as a block of its own; an empty table gives an
    empty result. Rows that repeat a doc_id are encoded one by one; other columns are ignored.
    """
    spark = docs.sparkSession
    spec = Path(tokenizer_file).read_text(encoding="utf-8")
    shared = spark.sparkContext.broadcast(spec)  # a few MB, fixed by the tokenizer
    blocks = to_blocks(docs.select("doc_id", "text", F.lit(True).alias("mark")), lambda: numbered(word_splitter(shared.value)()), "bpe")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(shared.value)
        known: dict[bytes, list[int]] = {}
        for _, block, nos, words, _ in opened(batches):
            new = [w for w in words if w not in known]
            plain = [w for w in new if w[:1] != SPECIAL]
            for a in range(0, len(plain), 4096):
                known.update(zip(plain[a : a + 4096], (e.ids for e in tok.encode_batch([w.decode() for w in plain[a : a + 4096]], add_special_tokens=False))))
            known.update((w, [tok.token_to_id(w[1:].decode())]) for w in new if w[:1] == SPECIAL)
            ids = [known[w] for w in words]
            lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (nos, packed(lengths), packed(flat)))], names=["block", "nos", "lengths", "ids"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = dealt(blocks, parts).mapInArrow(trimmed(encoded), "block long, nos binary, lengths binary, ids binary")
    table = table.groupBy("block").agg(F.collect_list(F.struct("nos", "lengths", "ids")).alias("found"))
    rows = blocks.select("block", "doc_ids", "sizes", "at").join(table.hint("merge"), "block", "left")

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.asarray(batch[1][i].values, np.int64)
                at, starts = unpacked(batch[2][i].as_py()), by_document(sizes)
                found = batch[3][i].as_py() or []
                nos, lengths, flat = (np.concatenate([np.zeros(0, np.int64), *(step(unpacked(x[k])) for x in found)]) for k, step in (("nos", np.cumsum), ("lengths", np.asarray), ("ids", np.asarray)))
                begin, size = np.zeros(len(nos), np.int64), np.zeros(len(nos), np.int64)
                begin[nos], size[nos] = np.cumsum(lengths) - lengths, lengths
                flat = flat.astype(np.int32)
                doc_ids = batch[0][i].values
                for a in range(0, len(sizes), 256):
                    b = min(a + 256, len(sizes))
                    own = at[starts[a] : starts[b]]
                    n = size[own]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    where = np.repeat(begin[own] - ends[:-1], n) + np.arange(ends[-1])
                    lists = pa.ListArray.from_arrays(pa.array(ends[starts[a : b + 1] - starts[a]], pa.int32()), pa.array(flat[where], pa.int32()))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), lists], names=["doc_id", "ids"])

    return rows.select("doc_ids", "sizes", "at", "found").mapInArrow(trimmed(laid_out), "doc_id long, ids array<int>")


def decode(ids: DataFrame, tokenizer_file: str) -> DataFrame:
    """Any rows with a column ids array<int>, and the text that decode(ids) of the library gives, special tokens kept.

    The pieces of the ids joined by blanks, through a join with the id-to-piece table; ids that the vocabulary doesn't
    have are left out, null ids give an empty text.
    """
    spec = Path(tokenizer_file).read_text(encoding="utf-8")
    pieces = vocabulary(ids.sparkSession, spec).select(F.col("page").alias("__lk_page"), F.col("pieces").alias("__lk_pieces"))
    rows = ids.withColumn("__lk_page", F.when(F.coalesce(F.size("ids"), F.lit(0)) >= -1, F.lit(0))).join(F.broadcast(pieces), "__lk_page")
    text = F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.get("__lk_pieces", i)), " ")
    return rows.select(*ids.columns, text.alias("decoded"))
