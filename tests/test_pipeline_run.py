"""The linkage run end to end: every entity once, ids of the other sources only, copies found."""

from tessera.operators import models
from tessera.operators.records import records, true_pairs
from tessera.plans import pipeline

SF = "/root/testdata/sf0.01"


def test_run(spark, tmp_path):
    r, t = records(spark, SF), true_pairs(spark, SF)
    out = pipeline.run(r.drop("doc_id"), t, str(tmp_path), pipeline.Params(trees=(8, 8), tfidf_max_df=(0.1, 0.1)))
    rows = out.collect()
    assert len(rows) == len({x.source1_entity_id for x in rows}) == r.where("source = 1").count()
    ids = [(x.source1_entity_id, i) for x in rows for i in x.matched_entity_ids.split(",") if i]
    assert ids and all(i.startswith(("S2-", "S3-")) for _, i in ids)
    real = {(x.s1_id, x.cand_id) for x in t.collect()}
    assert len(real & set(ids)) >= 0.3 * len(real)
    lists = spark.read.parquet(f"{tmp_path}/candidate_lists")
    assert lists.count() == len(rows) and lists.where("candidate_entity_ids <> ''").count() > 0
    recall = spark.read.parquet(f"{tmp_path}/prefilter_recall").first()
    assert 0 <= recall.prefilter_recall <= recall.blocking_recall <= 1
    model, features = models.load(f"{tmp_path}/model_a")
    assert features == pipeline.STAGE_A and model.getNumTrees == 8
