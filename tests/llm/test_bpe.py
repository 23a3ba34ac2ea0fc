import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from examlake.llm import bpe, token_counts
from examlake.llm.common import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "  \n\n  ", "a", " a", "a ", "a  b   c\n\n  d\t\te  ", "it's we'll 'S don''t", "x<|endoftext|>y <|endoftext|>\n<|endoftext|>",
    "a b   c  d  e\x1c \x1d f\x85 g​ h﻿", "日本語 テキスト。 123 ١٢٣ \U0001f600 \U0001f468‍\U0001f469", "՘֋Ᲊ ౜ x", "<|endoftext", "é" * 50 + " " * 70 + "\r\n\x0b\x0c z",
    "word " * 3000, "<|endoftext|>", "\t\ta\n b", "a \n", "a\n ", " \n a",
]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [np.asarray(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("head", [0, 5, 100_000])
def test_encode_and_decode_as_the_library(spark, sf, head):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(len(TEXTS) + i, r["text"], "y") for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").select("text").collect())]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, head=head), PATH).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t, _ in rows]
    for (i, t, _), ids in zip(rows, library(texts), strict=True):
        assert bytes(got[i]["ids"]) == ids, repr(t)[:80]
        assert got[i]["decoded"] == (t or "")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    assert token_counts.count_tokens(empty, PATH, new_path(spark, "counts")).count() == 0


def test_counts_come_from_the_cache(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "a"), (None, "only here"), (None, None)]
    docs, cache = spark.createDataFrame(rows, "doc_id long, text string"), new_path(spark, "counts")
    want = sorted(((i, len((t or "").encode()), len(ids) // 4) for (i, t), ids in zip(rows, library([t or "" for _, t in rows]), strict=True)), key=str)
    assert sorted((tuple(r) for r in token_counts.count_tokens(docs, PATH, cache).collect()), key=str) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows})
    assert sorted((tuple(r) for r in token_counts.count_tokens(docs, PATH, cache).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == stored, "a second run encodes nothing"
