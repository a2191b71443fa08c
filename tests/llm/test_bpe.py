import hashlib
import random

import numpy as np
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessera.llm import bpe

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.StringType())])
PARTS = list("aB'sdltΣσİéÉé \t\n\x1c\x1f\x85\xa0 ٣½²中字<|>endoftext!?_-​﻿😀") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "the quick ", "Whatever "]


def test_ids_and_texts_are_those_of_the_library(spark):
    rng, library = random.Random(3), Tokenizer.from_file(bpe.vocabulary_path())
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 40))), "x", "y") for i in range(1500)] + [(9000, None, "", ""), (9001, "", "", ""), (None, "abc " * 30_000, "", ""), (7, "twice", "", "")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.setdefault(i, []).append((ids, library.decode(ids, skip_special_tokens=False)))
    got = bpe.encode(frame, bpe.vocabulary_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.ids, r.decoded) in want[r.doc_id] and r.n_tokens == len(r.ids)
    for r in bpe.digests(frame, bpe.vocabulary_path()).collect():
        assert (r.ids_sha256, r.decoded_sha256) in [(hashlib.sha256(np.array(a, "<u4").tobytes()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()) for a, b in want[r.doc_id]]


def test_forgetting_words_changes_nothing():
    short = bpe.WordBPE(bpe.vocabulary_path())
    short.by_chunk.most = 3
    text = "one two three four five six one two three " * 3
    assert short.encode(text) == bpe.load(bpe.vocabulary_path()).encode(text)


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), bpe.vocabulary_path()).collect() == []
