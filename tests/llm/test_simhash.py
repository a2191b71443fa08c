import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("node", T.StringType())])


def plain_fingerprint(text):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    """doc_id -> least linked doc_id, from all pairs."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_and_components_match_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(150, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            base = list(base)
            base[rng.randrange(len(base))] = "changed"
            texts.append("\n".join(base))
    texts += ["", None, " \t", "one", "One", "a b", "a b c", "É x  y", "x y"] + [texts[0]] * 40
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want = {i: plain_fingerprint(t) for i, t, *_ in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == plain_components(want)


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a b c d", "", ""), (None, "z y x w v", "", ""), (4, "a b c d", "", ""), (4, "a b c d", "", "")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_finds_every_link():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    words = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centres] + [rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    rng.shuffle(words)
    first = simhash.GrayIndex(words).link(3)
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= 3
    group = np.arange(len(words))
    while True:
        least = np.where(near, group[None, :], len(words)).min(axis=1)
        if (least == group).all():
            break
        group = least
    assert len({*zip(first.tolist(), group.tolist())}) == len({*first.tolist()}) == len({*group.tolist()})


def test_nodes_over_the_limit_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_OVER", 5)
    rng = random.Random(1)
    prints = sorted({0xABC ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)})
    signed = {simhash._signed(p): p for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash._links(simhash._split(simhash._nodes(frame, 3), 3), 3)
    root = {signed[r.node]: signed[r.root] for r in components(links).collect()}
    want = plain_components({i: p for i, p in enumerate(prints)})
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(want[i], set()).add(root.get(p, p))
    assert all(len(x) == 1 for x in groups.values()) and len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_components_of_chains(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}
    assert components(links.limit(0)).collect() == []


def test_trees_of_all_sizes_answer(spark):
    """One index over nodes of 1 to 3,000 fingerprints finds what all pairs within each node give, and compares fewer."""
    rng = np.random.default_rng(5)
    words, upper = [], []
    for k, n in enumerate([1, 2, 2, 3, 8, 9, 17, 64, 65, 200, 1, 3000]):
        centre = rng.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)
        near = rng.choice(centre, n)
        for _ in range(3):
            near = near ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        near = np.unique(near)
        words.append(near)
        upper.append(np.full(len(near), 7 * k - 20))
    words, upper = np.concatenate(words), np.concatenate(upper)
    mixed = rng.permutation(len(words))
    words, upper = words[mixed], upper[mixed]
    index = simhash.GrayIndex(words, upper)
    got = index.link(3)
    pairs = 0
    for k in np.unique(upper):
        at = np.flatnonzero(upper == k)
        near = np.bitwise_count(words[at][:, None] ^ words[at][None, :]) <= 3
        group = np.arange(len(at))
        while not ((least := np.where(near, group[None, :], len(at)).min(axis=1)) == group).all():
            group = least
        assert {*got[at].tolist()} <= {*at.tolist()}
        assert len({*zip(got[at].tolist(), group.tolist())}) == len({*got[at].tolist()}) == len({*group.tolist()})
        pairs += len(at) ** 2
    assert len(index.nodes) >= 4 and 0 < index.compared < pairs / 5


def test_clashing_names_stay(spark):
    names = ["doc_id", "text", "_row", "__row", "fp", "text_hash", "root", "node"]
    rows = [(k, "a b c d e f g h" if k < 3 else "other words", *[f"{n}{k}" for n in names[2:]]) for k in range(4)]
    got = simhash.deduplicated(spark.createDataFrame(rows, names))
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[3]]
