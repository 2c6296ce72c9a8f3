import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from inkgraph.llm import bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        ranks = B.read_ranks(f.read())
    return B.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_matches_library(both):
    codec, library = both
    r = random.Random(4)
    texts = ["", "a" * 3000, "ab" * 2000, "the" * 1500, "".join(r.choice("abcdeths") for _ in range(8000)), " \n \u00a0 x\x85y\x1cz", "<|endoftext|> 中文 🚀é"]
    texts += ["".join(r.choice("aabbcde '\n\t .,12éß中文ñ🚀'sre") for _ in range(r.randrange(60))) for _ in range(400)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x3000, 0xD7FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(8)) for _ in range(400)]
    for t in texts:
        assert ids(codec.encode(t)) == library.encode_ordinary(t), t
        assert codec.decode(codec.encode(t)) == t.encode()


def test_ranks_that_go_back():
    """A merge may open a pair of lower rank than the one just done; equal ranks go left to right."""
    base = {bytes([b]): 300 + b for b in range(256)}
    ranks = base | {b"ab": 5, b"aba": 3, b"cc": 4, b"ccc": 2}
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    codec = B.Codec(ranks, r"[\s\S]+")
    r = random.Random(5)
    for t in ["abab", "ccccc", "abccab"] + ["".join(r.choice("abc") for _ in range(r.randrange(1, 30))) for _ in range(300)]:
        assert ids(codec.encode(t)) == library.encode_ordinary(t)


def test_columns(spark, both):
    rows = [(1, None), (2, ""), (3, "Hello wörld"), (3, "Hello wörld"), (None, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = B.share(spark, PATH)
    out = df.select("doc_id", "text", B.encode(F.col("text"), ranks, P.PATTERN).alias("ids"), B.round_trip(F.col("text"), ranks, P.PATTERN).alias("x")).withColumn("back", B.decode(F.col("ids"), ranks, P.PATTERN)).collect()
    for r in out:
        assert ids(r["ids"]) == both[1].encode_ordinary(r["text"] or "") and r["x"]["ids"] == r["ids"]
        assert bytes(r["back"]) == (r["text"] or "").encode() == bytes(r["x"]["decoded"])
    assert df.limit(0).select(B.encode(F.col("text"), ranks, P.PATTERN)).count() == 0
