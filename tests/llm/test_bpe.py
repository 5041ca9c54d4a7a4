import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from presswork.llm import bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HARD = [
    "", " ", "\n\n  \t x", "a" * 300, " " * 300, "we'll they'll 'll ''ll l'l", "1234567890" * 20,
    "ab  cd   ef\n\n\ngh" * 9, "naïve — “quotes”… 東京都   x\u0085y", "\x1c \x1d\x1f a\x0bb\x0cc",
    "<|endoftext|> word <|endoftext|>", "!?" * 120 + "x " * 40, "é ́ \U0001f600‍" * 20,
]


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 2048])
def test_tree_gives_the_ids_of_the_whole_text(text, leaf):
    encoding = bpe.encoder(RANKS)
    assert bpe.encode_tree(text, encoding, leaf, 1) == encoding.encode_ordinary(text)


def test_random_texts():
    rng, encoding = random.Random(5), bpe.encoder(RANKS)
    for _ in range(300):
        text = "".join(rng.choice("ab'slt  \n.1é東 !") for _ in range(rng.randrange(60)))
        ids = bpe.encode_tree(text, encoding, rng.choice([1, 2, 5, 11]), 1)
        assert ids == encoding.encode_ordinary(text)
        assert bpe.decode_tree(ids, encoding, 2) == text.encode()


def test_very_long_texts():
    encoding = bpe.encoder(RANKS)
    for text in ("word and " * 100_000, "x" * 60_000):
        assert bpe.encode_tree(text, encoding) == encoding.encode_ordinary(text)


def test_rows_with_nulls_repeats_and_clashing_names(docs):
    df = docs(None, "", "some text", "some text", (None, "x"))
    ids = df.select("doc_id", bpe.bpe_encode(F.col("text"), RANKS).alias("packed"))
    back = ids.select("doc_id", "packed", bpe.bpe_decode(F.col("packed"), RANKS).alias("b"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.packed), bytes(r.b))
                 for r in back.collect())
    want = bpe.encoder(RANKS).encode_ordinary("some text")
    assert [g[2] for g in got] == [b"x", b"", b"", b"some text", b"some text"]
    assert got[3][1] == struct.pack(f"<{len(want)}I", *want)
    assert ids.limit(0).select(bpe.bpe_decode(F.col("packed"), RANKS)).collect() == []


def test_query_against_the_library(spark, documents):
    encoding = bpe.encoder(RANKS)
    want = {}
    for r in documents.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    got = queries.QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
