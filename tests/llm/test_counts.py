import hashlib
import random

import public_tokenizers
from pyspark.sql import types as T

from tessera.llm import counts
from tessera.llm.bpe import vocabulary_path

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
PARTS = ["a", "b", " ", "  ", "\n", "'", "s", "'s", "'ll", "é", "1", "2", "!", "!!", "\t", "中", "word ", "The ", " "]


def counter():
    return counts.load(vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_edits_leave_the_pieces_of_the_whole_text():
    rng, c = random.Random(5), counter()
    for _ in range(1500):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 60)))
        doc = counts.Document(text, c, rng.choice([1, 2, 3, 5, 32]))
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, len(text) + 2)
            b, new = a + rng.choice([0, 1, 2, 5, 30]), "".join(rng.choices(PARTS, k=rng.choice([0, 1, 2, 6, 40])))
            doc.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert doc.text() == text and [p for x in doc.leaves for p in x] == c.pieces(text)
            assert doc.n_tokens == len(c.encoding.encode_ordinary(text)) and doc.n_chars == len(text)


def test_small_edits_of_long_texts_encode_little():
    rng, c = random.Random(6), counter()
    text = " ".join(f"word{rng.randrange(100)}" for _ in range(20_000))
    doc = counts.Document(text, c)
    before = doc.recounted
    doc.edit(50_000, 50_001, "xyz")
    assert doc.recounted - before <= 4 * counts.LEAF and doc.n_tokens == len(c.encoding.encode_ordinary(doc.text()))


def test_counts_against_whole_encodings(spark):
    rng, c = random.Random(7), counter()
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 300))), "x") for i in range(200)] + [(900, None, ""), (901, "", ""), (None, "a b " * 20_000, ""), (3, "again", "")]
    want = set()
    for i, t, _ in rows:
        t = new = t or ""
        for e in counts.sample_edits(len(t)):
            new = new[: e.start] + e.text + new[max(e.start, e.end) :]
        want.add((i, len(c.encoding.encode_ordinary(t)), len(c.pieces(t)), len(c.encoding.encode_ordinary(new)), len(new), hashlib.sha256(new.encode()).hexdigest()))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = counts.counted(frame, vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows) and {tuple(r)[:6] for r in got} == want
    assert counts.counted(frame.limit(0), vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []
