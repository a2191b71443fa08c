import random

import numpy as np

import corpus_pipeline
from tessera.llm import shingles, simhash


def plain(rows, least=0.8):
    """The smallest id of each component, by comparing all pairs."""

    def cut(text):
        w = (text or "").lower().split()
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, root = {i: cut(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[i] != root[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return sorted(set(root.values()))


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"e{rng.randrange(10**6)}"
    return words


def test_edited_copies_are_found_by_the_stage(spark):
    rng = random.Random(3)
    rows, line = [], " ".join(f"c{k}" for k in range(12))
    for k in range(40):  # families of edited copies around the threshold, all with one common line
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 100, 400]))]
        rows += [(10 * k + j, f"{line} {' '.join(edited(rng, words, j * len(words) // 90))}", "x") for j in range(4)]
    big = [f"b{k}" for k in range(200)]
    rows += [(1000 + k, " ".join(edited(rng, big, 2)), "x") for k in range(150)]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "One two", "x"), (2003, "one TWO", "x"), (2004, "one two three", "x")]
    rows += [(3000 + k, f"{line} {k}", "x") for k in range(80)]  # a common line makes most of the text
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == plain([(i, t) for i, t, _ in rows])


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in simhash.deduplicated(docs, shingle=5, least=0.8).collect()) == [(-1, "other"), (4, "a b c d e f")]
    assert simhash.deduplicated(docs.limit(0), shingle=5, least=0.8).collect() == []


def test_parities_lose_no_similar_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.uniform(0.5, 1)], rng.integers(0, 2**63, int(rng.integers(0, n)), dtype=np.uint64))))
        kept = shingles.perhaps(shingles.parities(a), len(a), shingles.parities(b), len(b), 0.8)
        assert kept or not shingles.similar(a, b, 0.8)
    a, b = (np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2))
    assert not shingles.perhaps(shingles.parities(a), len(a), shingles.parities(b), len(b), 0.8)
    none = np.empty(0, np.uint64)
    assert shingles.perhaps(shingles.parities(none), 0, shingles.parities(none), 0, 0.8) and len(shingles.parities(none)) == 8


def test_large_families_without_a_centre(spark, monkeypatch):
    """Sets of one family that are mostly unlike each other: blocks give the components of all pairs."""
    monkeypatch.setattr(shingles, "MANY", 8)
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.randint(1, 12)))) for k in range(150)]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=5, least=0.8)
    want = plain(rows)
    assert sorted(r.doc_id for r in got.collect()) == want and 10 < len(want) < 140
