import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from tessera.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("target", T.StringType())])


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, share=1.5, most=2):
    """Targets by pouring out the excess again and again."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    left, target = share * sum(sizes.values()), {}
    while True:
        open_ = [n for n in names if n not in target]
        level = left / sum(weight[n] for n in open_) if open_ else 0
        above = [n for n in open_ if weight[n] * level >= most * sizes[n]]
        for n in above:
            target[n] = most * sizes[n]
            left -= target[n]
        if not above:
            return target | {n: weight[n] * level for n in open_}


def rows_of(rng, n):
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["b", "c", "d", "é", None])
        rows.append((i, " x\t".join(f"w{rng.randrange(9)} " for _ in range(rng.randint(0, 80))), source, "s", "t"))
    return rows + [(None, "a b c", "b", "", ""), (7000, None, "c", "", ""), (7001, "", None, "", ""), (7002, "of no words", "tiny", "", ""), (7003, "", "none", "", "")]


def test_targets_and_words_taken(spark):
    rows = rows_of(random.Random(1), 1500)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = mixing.mixed(frame, shard_rows=400).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r._mix["size"]) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, *_ in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r._mix["size"]
        taken[r.source] += r._mix["taken"]
        assert 0 <= r._mix["taken"] <= 2 * r._mix["size"]
    want = filled(sizes)
    for r in got:
        assert r._mix["source_size"] == sizes[r.source] and r._mix["target"] == pytest.approx(want[r.source])
    for n in sizes:
        assert abs(taken[n] - want[n]) <= 16 * 4 + 0.005 * want[n]
    again = {(r.doc_id, r._mix["taken"]) for r in mixing.mixed(frame.repartition(3), shard_rows=400).collect()}
    assert again == {(r.doc_id, r._mix["taken"]) for r in got}


def test_the_documents_of_the_mix_hold_what_is_taken(spark):
    rows = rows_of(random.Random(2), 300)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: r._mix["taken"] for r in mixing.mixed(frame).collect()}
    got = defaultdict(int)
    out = mixing.documents(frame)
    assert out.columns == frame.columns
    for r in out.collect():
        got[r.doc_id] += size(r.text)
    assert {i: n for i, n in want.items() if n} == dict(got)


def test_apportionment_matches_highest_quotients():
    rng = random.Random(3)
    for _ in range(300):
        n, house = rng.randint(1, 8), rng.randint(0, 300)
        weights, caps = [rng.choice([0, rng.random() * 100]) for _ in range(n)], [rng.randint(0, 120) for _ in range(n)]
        quotients = sorted((-w / (2 * k + 1), i) for i, (w, c) in enumerate(zip(weights, caps)) if w > 0 for k in range(c))
        counts = Counter(i for _, i in quotients[:house])
        assert mixing.apportioned(weights, caps, house) == [counts[i] for i in range(n)]
    assert mixing.apportioned([3.0, 1.0], [10**9, 10**9], 10**8) == [75_000_000, 25_000_000]


def test_empty_tables_and_texts(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r._mix["taken"] for r in mixing.mixed(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).collect()] == [0]


def test_rows_that_repeat_are_spread_and_names_may_clash(spark):
    names = ["doc_id", "text", "source", "_mix_key", "_copy", "row", "size", "order", "shard", "mix"]
    rows = [(7, "same text of five words", "a", *["k"] * 7)] * 4000 + [(100 + k, " ".join(["w"] * (k % 9 + 1)), "b", *[str(k)] * 7) for k in range(500)]
    docs = spark.createDataFrame(rows, names).repartition(5)
    got = mixing.mixed(docs, shard_rows=300).collect()
    assert len(got) == len(rows) and {r._mix_key for r in got if r.doc_id == 107} == {"7"}
    taken, sizes = Counter(), Counter()
    for r in got:
        taken[r.source] += r._mix["taken"]
        sizes[r.source] += r._mix["size"]
    want = filled(sizes)
    assert all(abs(taken[n] - want[n]) <= 16 * 16 + 0.005 * want[n] for n in want)
    out = mixing.documents(docs, shard_rows=300)
    assert out.columns == names and {(r._copy, r.shard) for r in out.where("doc_id = 107").collect()} <= {("7", "7")}
    assert mixing.mixed(docs, mix_col="mix").columns == names
