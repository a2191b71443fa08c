import hashlib
import random

import numpy as np
from pyspark.sql import types as T

from tessera.llm import minhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("part", T.StringType()), T.StructField("extra", T.StringType())])


def plain(text):
    """The signature by sorting every element of every component."""
    e, place = minhash.kmers(text or "")
    if not len(e):
        return np.zeros(minhash.COMPONENTS, np.uint32)
    order = [[] for _ in range(minhash.COMPONENTS)]
    for r in range(64):
        x = minhash._mix(e + np.uint64(r * int(minhash._P[1]) % 2**64))
        for k, v in enumerate(x.tolist()):
            order[v >> 57].append((r, (v & (1 << 57) - 1) >> 6, k))
    out = []
    for c, found in enumerate(order):
        chosen = []
        last = minhash._mix(e + np.uint64((c + 1000) * int(minhash._P[2]) % 2**64))
        for *_, k in sorted(found) + sorted((64, v, k) for k, v in enumerate(last.tolist())):
            if k not in chosen:
                chosen.append(k)
        want = min(minhash.TUPLE, len(e))
        h = np.array([want], np.uint64)
        for k in sorted(chosen[:want], key=lambda k: place[k]):
            h = minhash._mix(h * minhash._P[0] + e[k])
        out.append(int(h[0]) >> 40)
    return np.array(out, np.uint32)


def prose(rng, n):
    return " ".join(rng.choice(["stone", "river", "walk", "green", "seven", "lamp", "of", "the", "über"]) + str(rng.randrange(50)) for _ in range(n))


def test_signatures_match_a_full_sort():
    rng = random.Random(3)
    for text in ["", None, "a", "ab" * 3, "elevenchars", "twelve chars", "x" * 40, prose(rng, 5), prose(rng, 60), prose(rng, 700), "same " * 300, "😀é" * 20]:
        assert (minhash.signature(text) == plain(text)).all()


def test_likeness_follows_edits_and_order():
    rng = random.Random(4)
    a, b = prose(rng, 400), prose(rng, 400)
    s = minhash.signature(a)
    small = a[:900] + "#" + a[901:]
    half = minhash.edited(a, b)
    moved = a[len(a) // 2 :] + a[: len(a) // 2]
    near = [minhash.likeness(s, minhash.signature(x)) for x in (a, small, moved, half, b)]
    assert near[0] == 1 and near[1] > 0.9 and near[1] > near[2] > near[3] > near[4] and near[4] < 0.1


def test_rows_follow_each_other_by_descending_id(spark):
    rng = random.Random(5)
    rows = [(i * 3, prose(rng, rng.randint(0, 60)), "x", "y") for i in range(150)] + [(1000, None, "", ""), (1001, "", "", ""), (1002, "é😀" * 5, "", ""), (None, "last of all", "", "")]
    rows += [(6000, "z" * 200_000, "", "")]
    want, ordered = {}, sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, t, *_) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        s, other = minhash.signature(t), minhash.signature(new)
        want[i] = (i, len(t), hashlib.sha256(new.encode()).hexdigest(), minhash.shown(s), minhash.shown(other), (s == other).mean(), (s == minhash.signature(following)).mean())
    rng.shuffle(rows)
    got = minhash.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r) for r in got} == want


def test_repeated_ids_one_row_and_none(spark):
    rows = [(5, "aa", "", ""), (5, "bb", "", ""), (5, "aa", "", ""), (1, "cc", "", ""), (9, "dd", "", ""), (9, "dd", "", "")]
    assert sorted(r.doc_id for r in minhash.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == [1, 5, 5, 5, 9, 9]
    one = minhash.fingerprints(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert minhash.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
