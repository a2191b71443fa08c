"""Decisions, metric, search, decoder, validator, IO: small cases and invariants."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking, corpus, decide, evaluate, models, pairs, profile, splits
from tessera.sources import io

SCORED = "s1_id string, cand_id string, p_match double"


def test_decide(spark):
    rows = spark.createDataFrame([("s1", "c1", 0.9), ("s2", "c1", 0.8), ("s2", "c2", 0.6)], SCORED)
    assert [tuple(r)[:2] for r in decide.decide(rows, 0.5, 0.7).collect()] == [("s1", "c1")]
    many = spark.createDataFrame([("s1", f"c{k:02}", 0.9) for k in range(20)], SCORED)
    assert sorted(r.cand_id for r in decide.decide(many).collect()) == [f"c{k:02}" for k in range(12)]


@pytest.mark.parametrize("predicted, truth, want", [(["S2-47", "S2-193", "S3-812"], ["S2-47", "S3-812"], 0.714), ([], [], 1.0), (["a"], [], 0.0), ([], ["a"], 0.0)])
def test_f_beta(spark, predicted, truth, want):
    frame = spark.createDataFrame([(predicted, truth)], "p array<string>, t array<string>")
    assert frame.select(evaluate.f_beta(F.col("p"), F.col("t")).alias("f")).first().f == pytest.approx(want, abs=5e-4)


@pytest.mark.parametrize("q, want", [([0.5], 0), ([0.9], 1), ([0.9, 0.6], 1), ([], 0), ([0.99, 0.99], 2)])
def test_decoder(q, want):
    assert decide.prefix_size(q, 0.0) == want


def test_grid_matches_single_decisions(spark):
    import random

    rng = random.Random(1)
    rows = [(f"s{rng.randrange(25)}", f"c{rng.randrange(40)}", round(rng.random(), 2)) for _ in range(160)]
    rows = list({(a, b): (a, b, p) for a, b, p in rows}.values())
    scored = spark.createDataFrame(rows, SCORED)
    truth = spark.createDataFrame([(f"s{k}", [f"c{k}", f"c{k + 1}"] if k % 3 else []) for k in range(25)], "s1_id string, ids array<string>")
    got = {(r.pair, r.singleton): r.f for r in evaluate.grid_scores(truth, scored, evaluate.grid(spark, [0.3, 0.5], [0.5, 0.7])).collect()}
    for (p, s), f in got.items():
        assert evaluate.macro(evaluate.entity_scores(truth, decide.decide(scored, p, s))).first().f == pytest.approx(f)
    pair, single, best = evaluate.tune(truth, scored)
    assert 0 <= pair <= single <= 1 and best >= max(got.values()) - 1e-9


def test_unseen_country():
    assert evaluate.unseen_country((0.6, 0.7), []) == (0.6, 0.7)
    assert evaluate.unseen_country((0.6, 0.7), [(0.62, 0.8)]) == (0.6, 0.7)
    assert evaluate.unseen_country((0.6, 0.7), [(0.7, 0.8), (0.8, 0.9)]) == pytest.approx((0.75, 0.85))


def test_blocks_over_the_cap_are_dropped(spark):
    rows = [("S1-1", 1, "k")] + [(f"S2-{k}", 2, "k") for k in range(201)] + [("S1-2", 1, "m"), ("S3-1", 3, "m"), ("S3-1", 3, "m")]
    r = spark.createDataFrame([(*x, "c") for x in rows], "entity_id string, source int, w string, country string")
    got = blocking.key_arm(r.where("source = 1"), r.where("source > 1"), F.array("w"), 200).collect()
    assert [tuple(x) for x in got] == [("S1-2", "S3-1", "S3")]


def test_accept_and_merge(spark):
    counts = spark.createDataFrame([("co", "company", 7), ("co", "colony", 3), ("xy", "xylo", 2)], "short string, long string, n long")
    assert [tuple(r) for r in corpus.accepted(counts).collect()] == [("co", "company")]
    layer = lambda *p: spark.createDataFrame(list(p), "short string, long string")
    assert [tuple(r) for r in corpus.merged([layer(("a", "x")), layer(("a", "y"))]).collect()] == []
    assert [tuple(r) for r in corpus.merged([layer(("a", "x")), layer(("a", "y")), layer(("a", "z"))]).collect()] == [("a", "z")]


def test_buckets_and_groups(spark):
    b = spark.createDataFrame([(n,) for n in (0, 1, 3, 5, 6, 120)], "n int").select(splits.bucket(F.col("n")).alias("b"))
    assert [r.b for r in b.collect()] == ["0-0", "1-1", "2-3", "4-5", "6-99", "6-99"]
    e = spark.createDataFrame([(f"e{k}", "c", 1) for k in range(100)], "entity_id string, country string, match_count int")
    assert {r.group: r["count"] for r in splits.stratified(e).groupBy("group").count().collect()} == {"R": 15, "G": 25, "V": 10, "unused": 50}
    assert splits.holdout(e, "entity_id").where("held = 1").count() == 10


def test_id_lists_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    p = spark.createDataFrame([("S1-1", "S2-9", 0.9), ("S1-1", "S3-1", 0.95), ("S1-1", "S2-9", 0.2)], "s1_id string, cand_id string, p double")
    lists = io.id_lists(e, p, order=-F.col("p"))
    io.write_id_lists(lists, str(tmp_path / "out"))
    assert {r.source1_entity_id: r.ids for r in io.read_id_lists(spark, str(tmp_path / "out")).collect()} == {"S1-1": ["S3-1", "S2-9"], "S1-2": []}
    with pytest.raises(ValueError):
        io.write_id_lists(lists.unionByName(lists), str(tmp_path / "twice"))


def test_validator(spark):
    out = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-1"), ("S1-9", "S2-2")], "source1_entity_id string, matched_entity_ids string")
    e = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    cand = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_ids string")
    got = sorted(r.rule for r in evaluate.findings(out, e, candidates=cand).collect())
    assert got == ["bad_prefix", "duplicate_row", "extra_entity", "missing_entity", "not_candidate", "not_candidate", "repeated_id", "self_match"]


def test_models_learn_calibrate_and_encode(spark):
    rows = spark.createDataFrame([(f"s{k % 50}", f"c{k}", k / 400, None if k % 7 == 0 else float(k % 5), int(k > 200)) for k in range(400)], "s1_id string, cand_id string, a double, b double, y int")
    model = models.train(rows, ["a", "b"], trees=5, depth=2)
    scored = models.score(model, rows, ["a", "b"])
    assert scored.where("(p_match > 0.5) = (y = 1)").count() > 390 and models.importance(model, ["a", "b"])[0][0] == "a"
    cal = models.calibrate(scored, scored)
    assert cal.agg(F.min("p_cal").alias("a"), F.max("p_cal").alias("b")).first() == (1e-5, 1 - 1e-5)
    enc = models.encoded(spark.createDataFrame([("hello world",), (None,)], "t string"), "t", models.hashed_encoder(16))
    norms = enc.select(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v).alias("n")).collect()
    assert norms[0].n == pytest.approx(1, abs=1e-5) and norms[1].n == 0
    stage = rows.select("s1_id", "cand_id", F.col("a").alias("stage_a_score"))
    casc = models.cascade(stage, lambda d: d.withColumn("rerank_score", F.lit(0.5)))
    assert casc.count() == 400 and casc.where("rerank_score = 0.5").count() == casc.where("stage_a_score between 0.15 and 0.85").count()


def test_stage_b_has_66_features_and_anchors_13(spark):
    from tessera.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    b = QUERIES["stage_b_features"](spark, sf)
    assert len([c for c in b.columns if c.startswith("f_")]) == 66 and b.count() > 0
    assert len([c for c in QUERIES["anchor_features"](spark, sf).columns if c.startswith("an_")]) == 13
    assert pairs.listwise is not None


def test_saved_models_score_alike(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", k / 60, float(k % 3), int(k > 30)) for k in range(60)], "s1_id string, b double, a double, y int")
    model = models.train(rows, ["b", "a"], trees=3, depth=2)
    models.save(model, ["b", "a"], str(tmp_path / "m"))
    again, features = models.load(str(tmp_path / "m"))
    assert features == ["b", "a"]
    of = lambda m, f: sorted((r.s1_id, r.p_match) for r in models.score(m, rows, f).collect())
    assert of(model, ["b", "a"]) == of(again, features)


def test_decoder_search_and_margins(spark):
    rows = [(f"s{k}", f"c{k}-{j}", 0.9 - 0.2 * j, int(j == 0)) for k in range(40) for j in range(3)]
    scored = spark.createDataFrame(rows, "s1_id string, cand_id string, p_match double, y int")
    truth = spark.createDataFrame([(f"s{k}", "x" if k % 2 else None, [f"c{k}-0"]) for k in range(40)], "s1_id string, country string, ids array<string>")
    scale, decoder, thresholds = models.decoder_search(scored, truth)
    assert (scale, decoder, thresholds) == (0.0, 1.0, 1.0) and not models.adopt(thresholds, decoder)
    # a missed pair an entity makes longer lists: the column and the number say the same
    few = scored.where("p_match > 0.6")
    of = lambda extra, df: {(r.s1_id, r.cand_id) for r in decide.decode(df, extra).collect()}
    assert of(0.7, few) == of("more", few.withColumn("more", F.lit(0.7)))
    grid = evaluate.with_margins(evaluate.grid_scores(truth.select("s1_id", "ids"), scored, evaluate.grid(spark))).collect()
    assert sorted(r.g for r in grid) == list(range(273)) and {r.margin for r in grid} == {None, 0.05, 0.1}
    assert all(len({r.f for r in grid if r.g // 3 == k}) == 1 for k in range(91))


def test_profile_of_nothing_and_ties(spark):
    names = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1), ("c", 1), (None, 1), ("z", 2)], "name string, source int")
    assert sorted((r.source, r["rank"], r.name, r.n) for r in profile.common_names(names, 2).collect()) == [(1, 1, "c", 2), (1, 2, "a", 1), (2, 1, "z", 1)]
    assert profile.common_names(names.limit(0)).count() == 0
    values = spark.createDataFrame([(1, None), (1, " "), (1, "x"), (1, "x")], "source int, country string")
    assert sorted(((r.country, r.n) for r in profile.partition_values(values).collect()), key=repr) == [(" ", 1), ("x", 2), (None, 1)]
    pair = spark.createDataFrame([("a", "b"), ("a", "b")], "s1_id string, cand_id string")
    none = pair.limit(0)
    e = spark.createDataFrame([("a",)], "s1_id string")
    assert tuple(evaluate.prefilter_recall(e, none, pair, pair).first()) == (0, 0.0, 0.0, 0.0)
    assert tuple(evaluate.prefilter_recall(e, pair, pair, none).first()) == (1, 1.0, 0.0, 1.0)
