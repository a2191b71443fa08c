"""The whole linkage run over records of three sources: normalise, block, score, train, tune, decide, write."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import blocking, corpus, decide, evaluate, models, pairs, splits
from tessera.operators.records import normalised
from tessera.sources import io


@dataclass
class Params:
    """The knobs of a run, with their defaults."""

    seed: int = 42
    subsample: float = 1.0
    caps: tuple[int, int, int] = (200, 200, 100)
    tfidf_k: int = 10
    tfidf_max_df: tuple[float, float] = (0.01, 0.02)
    tfidf_least: float = 0.20
    union_cap: int = 40
    stage_a_top: int = 12
    trees: tuple[int, int] = (60, 100)


STAGE_A = ["f_name_jw", "f_name_sort", "f_name_set", "f_addr_set", "f_name_char3", "f_nums_jac", "f_loc_overlap", "f_house_eq", "f_postal_eq", "name_tfidf_score", "addr_tfidf_score", "name_tfidf_rank", "addr_tfidf_rank", "n_arms_hit", "key_locrare_hit", "key_house_hit", "key_acr_hit"]


def candidates(norm: DataFrame, p: Params) -> DataFrame:
    """The arms that need no encoder, united and capped."""
    q, pool = norm.where("source = 1"), norm.where("source > 1")
    arms = [
        blocking.arm_rows(blocking.sparse_topk(blocking.tfidf(norm, blocking.char_grams(F.col("core_name")), p.tfidf_max_df[0]), p.tfidf_k, p.tfidf_least), "name"),
        blocking.arm_rows(blocking.sparse_topk(blocking.tfidf(norm, blocking.word_grams(F.col("address_expanded")), p.tfidf_max_df[1]), p.tfidf_k, p.tfidf_least), "address"),
    ]
    keys = ((blocking.locality_keys(), "key_locrare_hit"), (blocking.house_keys(), "key_house_hit"), (blocking.acronym_keys(), "key_acr_hit"))
    arms += [blocking.arm_rows(blocking.key_arm(q, pool, k, cap, once=False), name) for (k, name), cap in zip(keys, p.caps)]
    return blocking.union_and_cap(arms, p.union_cap)


def run(records: DataFrame, truth: DataFrame, work: str, p: Params = Params()) -> DataFrame:
    """Id lists (source1_entity_id, matched_entity_ids) for every record of source 1.

    ``records``: entity_id, source, name, address, country; ``truth``: (s1_id, cand_id). ``work`` is a folder that all
    executors share: normalised records, candidates and features are written there and read again, so that a lost
    executor costs one step; candidate lists, the recall of the first stage and both models stay there, too.
    """
    spark = records.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    norm = kept(normalised(records), "normalised")
    entities = norm.where("source = 1").select(F.col("entity_id").alias("s1_id"), "country")
    counts = truth.groupBy("s1_id").agg(F.count("*").alias("n"))
    split = kept(splits.stratified(entities.join(counts, "s1_id", "left").select(F.col("s1_id").alias("entity_id"), "country", F.coalesce("n", F.lit(0)).alias("match_count")), p.seed, subsample=p.subsample), "split")
    group = lambda g: splits.members(split, g).withColumnRenamed("entity_id", "s1_id")
    cand = kept(candidates(norm, p), "candidates")
    rows = pairs.labelled(kept(pairs.stage_a(cand, norm), "stage_a"), truth)
    first = models.train(rows.join(group("G"), "s1_id", "left_semi"), STAGE_A, trees=p.trees[0], rate=0.05, seed=p.seed)
    models.save(first, STAGE_A, f"{work}/model_a")
    top = kept(models.top_by_score(models.score(first, rows, STAGE_A, "stage_a_score"), p.stage_a_top), "prefiltered")
    ids = entities.select(F.col("s1_id").alias("source1_entity_id"))
    kept(io.id_lists(ids, top, "candidate_entity_ids", order=-F.col("stage_a_score")), "candidate_lists")
    kept(evaluate.prefilter_recall(group("V"), truth, cand, top), "prefilter_recall")
    full = pairs.stage_b(top.drop("y"), norm, corpus.token_idf(norm, X.tokens("core_name")), corpus.name_frequency(norm))
    full = pairs.labelled(kept(full, "features"), truth)
    features = [c for c in full.columns if c.startswith("f_")]
    second = models.train_stage_b(full.join(group("G"), "s1_id", "left_semi"), features, trees=p.trees[1], seed=p.seed)
    models.save(second, features, f"{work}/model_b")
    scored = kept(models.score(second, full, features).select("s1_id", "cand_id", "cand_source", "p_match"), "scores")
    lists = truth.groupBy("s1_id").agg(F.collect_set("cand_id").alias("ids"))
    real = group("V").join(lists, "s1_id", "left").select("s1_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    pair, single, _ = evaluate.tune(real, scored.join(group("V"), "s1_id", "left_semi"))
    matched = decide.decide(scored, pair, single)
    return io.id_lists(ids, matched, order=-F.col("p_match"))


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("records", help="parquet: entity_id, source, name, address, country")
    args.add_argument("truth", help="parquet: s1_id, cand_id")
    args.add_argument("work", help="a shared folder for what the steps write")
    args.add_argument("out", help="where the tab-separated id lists go")
    a = args.parse_args()
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    io.write_id_lists(run(spark.read.parquet(a.records), spark.read.parquet(a.truth), a.work), a.out)


if __name__ == "__main__":
    main()
