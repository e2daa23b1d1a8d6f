import pytest
from tokenizers import Tokenizer

from larkspur.llm import bpe
from larkspur.llm.queries import tokenizer_file

ROWS = [
    (1, "The quick brown fox's tail, don't! 12.5%"), (2, None), (3, ""), (4, "  \n\t "), (5, "<|startoftext|>Hello <|endoftext|><|ENDOFTEXT|> <|end"), (6, "Élan ΣΑΣ ΌΣΟΣ ǅ İstanbul ﬁ"), (7, "é vs é; 日本語テスト 한국어 ２３ Ⅷ ½ ² ª µ"),
    (8, "a\x1cb\x85c\xa0d e​f\x0bg"), (9, "emoji 👩‍👩‍👧 \U0001f1e8\U0001f1ee ok"), (10, "word " * 60_000), (11, "x" * 5000), (11, "same id"), (None, "no id"), (12, "'S 'LL 'ſ ''s --'s"), (13, "\0 nul"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def check(rows, texts, library):
    wanted = sorted((str(d), (ids := library.encode(t or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False)) for d, t in texts)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == wanted


def test_equal_to_the_library(docs, library):
    rows = bpe.decode(bpe.encode(docs(ROWS), tokenizer_file()), tokenizer_file())
    check(rows.collect(), ROWS, library)


def test_documents(spark, sf_dir, library):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = bpe.decode(bpe.encode(frame, tokenizer_file()), tokenizer_file()).collect()
    check(rows, [(r.doc_id, r.text) for r in frame.collect()], library)


def test_empty_tables_and_unknown_ids(docs, spark):
    assert bpe.encode(docs([]), tokenizer_file()).count() == 0
    odd = spark.createDataFrame([(1, [320, 10**6, 49407]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(odd, tokenizer_file()).collect()} == {1: "a</w> <|endoftext|>", 2: "", 3: ""}
