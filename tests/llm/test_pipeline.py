"""The pipeline against a plain version of each stage, on the smallest tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, quality, registry
from tests.llm.test_mixing import filled, size
from tests.llm.test_shingles import plain as plain_similar
from tests.llm.test_substrings import plain as plain_substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        columns = docs.columns
        frame = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or frame.columns == columns
        frame.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_quality_stage(spark, stages):
    before, after = stages[0], stages[1]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    scores = model.score(np.array([quality.statistics(r.text) for r in before]))
    assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, scores) if s >= 0.7}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {r.doc_id for r in after}
    assert len(good & kept) >= 0.9 * len(good)


def test_near_duplicate_stage(stages):
    before, after = stages[1], stages[2]
    assert sorted(r.doc_id for r in after) == plain_similar([(r.doc_id, r.text) for r in before])
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after)


def test_substring_stage(stages):
    want = {i: kept for (i, _), (kept, _) in plain_substrings([(r.doc_id, r.text) for r in stages[2]]).items()}
    assert {r.doc_id: r.text for r in stages[3]} == want
    assert all(r.n_chars == len(r.text) for r in stages[3])


def test_mixing_stage(stages):
    sizes, taken = Counter(), Counter()
    own, got = {r.doc_id: size(r.text) for r in stages[3]}, defaultdict(int)
    for r in stages[3]:
        sizes[r.source] += size(r.text)
    for r in stages[4]:
        taken[r.source] += size(r.text)
        got[r.doc_id] += size(r.text)
    assert all(n <= 2 * own[i] for i, n in got.items())
    for n, want in filled(sizes).items():
        assert abs(taken[n] - want) <= 32 + 0.01 * want
    texts = {r.doc_id: " ".join(r.text.split()) for r in stages[3]}
    assert all(" ".join(r.text.split()) in texts[r.doc_id] for r in stages[4])


def test_bpe_stage(stages):
    library, want = Tokenizer.from_file(bpe.vocabulary_path()), Counter()
    for r in stages[4]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert want == Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in stages[5])


def test_run_gives_the_last_stage(spark, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[5])


def test_every_operator_is_registered_and_runs(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, f in registry.queries().items():
        rows = f(spark, SF).count()
        assert rows == n if not name.startswith(("op2_", "op10_")) else rows > 0
