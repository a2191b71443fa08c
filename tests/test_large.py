"""What large tables need: copies share one vector, blocks of any size give the same, pairs meet once."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import blocking


def test_sparse_search_in_blocks(spark):
    """Against all products; copies, ties over the k-th place, empty and missing texts, a repeated id."""
    words = ["aa bb", "bb cc", "aa", "aa bb", "cc dd aa", "", "bb cc aa", "ee", "ee ff", "ff gg bb"]
    rows = [(f"S{k % 3 + 1}-{k:03}", k % 3 + 1, "x" if k % 7 else "y", None if k == 40 else words[k * 7 % 10]) for k in range(90)] + [("S2-001", 2, "x", "bb")]
    frame = spark.createDataFrame(rows, "entity_id string, source int, country string, t string")
    of = {}
    for e, s, c, t in rows:
        of.setdefault((c, e, s), Counter()).update(x for w in [(t or "").split()] for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    n, df = Counter(r[2] for r in rows), Counter((c, t) for (c, _, _), ts in of.items() for t in ts)
    vectors = {}
    for (c, e, s), ts in of.items():
        v = {t: (1 + math.log(m)) * (math.log((1 + n[c]) / (1 + df[c, t])) + 1) for t, m in ts.items() if 2 <= df[c, t] <= max(2.0, n[c] * 0.6)}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[c, e, s] = {t: x / size for t, x in v.items()}
    want = set()
    for (c, e, s), v in vectors.items():
        for pool in (2, 3) if s == 1 else ():
            near = [(-round(x, 9), i) for (d, i, p), u in vectors.items() if d == c and p == pool and round(x := sum(v[t] * u.get(t, 0.0) for t in v), 9) > 0.2]
            want |= {(e, i, f"S{pool}", round(-x, 6), r) for r, (x, i) in enumerate(sorted(near)[:4])}
    assert len(want) > 100
    for block in (5, 1000):
        got = blocking.tfidf_topk(frame, "t", blocking.word_grams, 0.6, k=4, block=block).collect()
        assert {(r.s1_id, r.cand_id, r.cand_source, round(r.score, 6), r["rank"]) for r in got} == want and len(got) == len(want)


def test_many_pairs_are_compared_as_single_ones():
    import random

    from tessera.functions import similarity as S

    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdé😀") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(9)))
    a = [text() for _ in range(1500)] + ["", "", "a", " ", "ab" * 200, "\ud800x"]
    b = [x if rng.random() < 0.1 else text() for x in a[:1500]] + ["", "a", "", "", "ba" * 150, "x\ud800"]
    for one, many in ((S.jaro_winkler_of, S.jaro_winkler_all), (S.token_sort_of, S.token_sort_all), (S.token_set_of, S.token_set_all), (S.partial_of, S.partial_all)):
        assert many(a, b).tolist() == [one(x, y) for x, y in zip(a, b)]


def test_records_meet_at_their_least_common_key(spark):
    """The pairs of the arm, once each, with both records."""
    rows = [(f"S{k % 3 + 1}-{k % 150:03}", k % 3 + 1, "xy"[k % 2] if k % 150 else None, [f"w{k % 5}", f"v{k % 11}", f"u{k % 40}"]) for k in range(153)]
    r = spark.createDataFrame(rows, "entity_id string, source int, country string, w array<string>")
    q, p = r.where("source = 1"), r.where("source > 1")
    want = sorted(tuple(x) for x in blocking.key_arm(q, p, F.col("w"), 8).collect())
    got = blocking.key_pairs(q, p, F.col("w"), 8, {"w": F.col("w")})
    assert len(want) > 50 and sorted((x.s1_id, x.cand_id, x.cand_source) for x in got.collect()) == want
    twice = {"S1-000", "S2-001", "S3-002"}
    assert all(set(x.s_w) & set(x.c_w) for x in got.collect() if x.s1_id not in twice and x.cand_id not in twice)


def test_cells_of_many_copies_are_split(spark, monkeypatch):
    """All cells probed: the same as the exact search, ties by id, whatever the size of a block."""
    monkeypatch.setattr(blocking, "DENSE_BLOCK", 7)
    row = lambda k: (k, [1.0, 0.0] if k % 3 else [math.cos(k), math.sin(k)], 0)
    q, p = (spark.createDataFrame([row(k) for k in ids], "id long, vector array<double>, part int") for ids in (range(0, 60, 4), range(100, 160)))
    got, want = (sorted((r.s1_id, r.cand_id, round(r.score, 9), r["rank"]) for r in f.collect()) for f in (blocking.dense_ivf(q, p, k=5, lists=6, probed=1.0), blocking.dense_knn(q, p, k=5)))
    assert got == want and len(got) == 15 * 5


def test_sparse_search_ships_texts_not_vectors(spark):
    """Long form, vectors and copies' ranks were shuffled before: 1,870 bytes a row here, now 320."""
    from tests.shuffles import shuffled

    words = ["".join(chr(97 + (k * j + j) % 26) for j in range(1, 8)) for k in range(1, 120)]
    row = lambda k: (f"S{k % 3 + 1}-{k:05}", k % 3 + 1, "x", " ".join(words[k * k * j % 119] for j in range(1, 7)) + f" n{k}")
    frame = spark.createDataFrame([row(k) for k in range(3000)], "entity_id string, source int, country string, t string")
    assert 0 < shuffled(spark, blocking.tfidf_topk(frame, "t", blocking.char_grams, 0.1)) < 600 * 3000


def test_stage_b_ships_ids_and_compares_in_blocks(spark):
    """Records travel once a block, not once a pair, and features are those of single pairs; pairs without a record drop out before ranks."""
    from pyspark.sql import Row

    from tessera.functions import similarity as S
    from tessera.functions import text as X
    from tessera.operators import corpus, pairs
    from tessera.operators.records import normalised
    from tests.shuffles import shuffled

    name = lambda k: " ".join(f"w{k * j % 41}x{k % 7}" for j in range(1, 6)) + (" ltd" if k % 3 else "")
    row = lambda s, k: Row(entity_id=f"S{s}-{k:05}", source=s, name=None if k == 7 else name(k + s), address=None if k == 9 else f"{k} Main Road {name(k * s)} 75{k % 9:03}", country="xy"[k * s % 2] if k % 11 else None)
    n = normalised(spark.createDataFrame([row(s, k) for s in (1, 2) for k in range(200)], "entity_id string, source int, name string, address string, country string")).cache()
    ids = spark.range(200).crossJoin(spark.range(200).toDF("c")).select(F.format_string("S1-%05d", "id").alias("s1_id"), F.format_string("S2-%05d", "c").alias("cand_id"), F.lit("S2").alias("cand_source"), (F.pmod(F.xxhash64("id", "c"), F.lit(1000)) / 1000).alias("stage_a_score"))
    lost = spark.createDataFrame([("S1-00003", "S3-99999", "S3", 2.0), ("S1-99999", "S2-00003", "S2", 2.0)], ids.schema)
    got = pairs.stage_b(ids.unionByName(lost).cache(), n, corpus.token_idf(n, X.tokens("core_name")), corpus.name_frequency(n))
    assert 0 < shuffled(spark, got) < 250 * 40_000
    own = pairs.prepared(n).select("entity_id", "core_name", "address_expanded", "phon", "g_core", "w_nums").collect()
    one, some = {r.entity_id: r for r in own}, got.where("pmod(xxhash64(s1_id, cand_id), 40) = 1 or cand_id = 'S2-00003' or s1_id = 'S1-00007'").collect()
    assert got.count() == 40_000 and len(some) > 1000 and max(r.f_rerank_max for r in some) < 1
    share = lambda a, b, none: len({*a} & {*b}) / len({*a, *b}) if {*a, *b} else none
    for r in some:
        a, b = one[r.s1_id], one[r.cand_id]
        assert r.f_name_jw_core == S.jaro_winkler_of(a.core_name, b.core_name) and r.f_addr_jw == S.jaro_winkler_of(a.address_expanded or "", b.address_expanded or "")
        assert r.f_name_partial == S.partial_of(a.core_name, b.core_name) and r.f_addr_set == S.token_set_of(a.address_expanded or "", b.address_expanded or "")
        assert (r.f_name_char3, r.f_nums_jac) == (share(a.g_core, b.g_core, 1.0), share(a.w_nums, b.w_nums, 0.0))
    both = pairs.sided(spark.createDataFrame(some, got.schema), pairs.with_idf(pairs.prepared(n), corpus.token_idf(n, X.tokens("core_name"))))
    weights = F.map_concat(F.map_filter("s.w_idf", lambda k, v: ~F.map_contains_key("c.w_idf", k)), F.col("c.w_idf"))
    want = {f: S.weighted_jaccard(F.col(f"s.{w}"), F.col(f"c.{w}"), weights) for f, w in (("f_name_idf_jac", "w_core"), ("f_street_idf_jac", "w_street"))} | {"f_name_lev": S.levenshtein(F.col("s.core_name"), F.col("c.core_name"))}
    held = both.select(*want, *[v.alias(f"want_{f}") for f, v in want.items()])
    assert held.where(" or ".join(f"abs({f} - want_{f}) > 1e-12 or want_{f} is null" for f in want)).count() == 0


def test_the_union_of_arms_is_shuffled_once(spark):
    """Each arm's pairs were shuffled for themselves, then all of them twice: 3.7 MB here, now 2.0."""
    from tessera.plans.queries import QUERIES
    from tests.shuffles import shuffled

    assert 0 < shuffled(spark, QUERIES["candidate_union"](spark, "/root/testdata/sf0.01")) < 2_800_000


def test_labels_and_context_take_two_shuffles_of_pairs(spark):
    """The columns of ``context`` over labelled pairs, with less shuffled than by both one after the other, which the query did before."""
    from tessera.operators import pairs
    from tests.shuffles import shuffled

    rows = [(f"S1-{i:04}", f"S{2 + j % 2}-{(i * j) % 300:04}", f"S{2 + j % 2}", ((i * 37 + j * 11) % 100) / 100) for i in range(300) for j in range(1, 40)]
    p = spark.createDataFrame(rows, "s1_id string, cand_id string, cand_source string, p_match double").dropDuplicates(["s1_id", "cand_id"])
    true = spark.createDataFrame([(a, b) for a, b, _, _ in rows[::9]] + [rows[0][:2], ("S1-0001", "S3-9999"), ("S1-9999", "S2-0001")], "s1_id string, cand_id string")
    old, new = pairs.context(pairs.labelled(p, true)), pairs.with_gaps(pairs.labelled_context(p, true))
    plain = lambda f: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.select(*sorted(old.columns)).collect())
    assert sorted(old.columns) == sorted(new.columns) and plain(old) == plain(new)
    a, b = shuffled(spark, old), shuffled(spark, new)
    assert 0 < b < 0.9 * a
