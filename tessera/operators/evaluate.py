"""Set-valued evaluation, threshold search, and the checks of an output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BETA2 = 0.25
COARSE = [round(0.30 + 0.05 * k, 2) for k in range(13)]
#: Margins of the coarse grid; null is none.
MARGINS = (None, 0.05, 0.10)


def f_beta(predicted: Column, truth: Column) -> Column:
    """F0.5 of two id arrays as sets: 1 if both are empty, 0 if one is."""
    p, t = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(truth))
    both = F.size(F.array_intersect(predicted, truth))
    return F.when((p == 0) & (t == 0), 1.0).when(both == 0, 0.0).otherwise((1 + BETA2) * both / (p + BETA2 * t))


def entity_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each entity of ``truth`` (s1_id, ids) with its predicted ids (pairs s1_id, cand_id; none counts as empty) and f."""
    lists = predicted.groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("predicted"))
    rows = truth.join(lists, "s1_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    return rows.withColumn("f", f_beta(F.col("predicted"), F.col("ids")))


def macro(scores: DataFrame) -> DataFrame:
    """One row: mean F over all, singletons and others, empty predictions, mean matches."""
    single, empty = F.size("ids") == 0, F.size("predicted") == 0
    return scores.agg(
        F.count("*").alias("entities"), F.avg("f").alias("f"), F.avg(F.when(single, F.col("f"))).alias("f_singletons"), F.avg(F.when(~single, F.col("f"))).alias("f_others"),
        F.count_if(empty).alias("predicted_empty"), F.avg(empty.cast("double")).alias("empty_rate"), F.avg(F.size("predicted")).alias("mean_matches"),
    )


def grid(spark: SparkSession, pairs=COARSE, singletons=COARSE) -> DataFrame:
    """Threshold pairs with pair <= singleton, numbered in order: a fixed number of rows."""
    rows = [(p, s) for p in pairs for s in singletons if p <= s]
    return spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(rows)], "g int, pair double, singleton double")


def grid_scores(truth: DataFrame, scored: DataFrame, thresholds: DataFrame, cap: int = 12) -> DataFrame:
    """Macro F of every row of the grid in one pass: g, pair, singleton, f.

    A candidate's winner does not depend on the pair threshold, so the one-to-one step comes first; each entity's scores
    are one sorted array, of which a threshold takes a prefix. The grid, of fixed size, is broadcast.
    """
    from tessera.operators.decide import one_to_one

    real = truth.select("s1_id", F.explode("ids").alias("cand_id")).withColumn("y", F.lit(1))
    best = one_to_one(scored).select("s1_id", "cand_id", "p_match").join(real, ["s1_id", "cand_id"], "left")
    lists = best.groupBy("s1_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p_match")).alias("m"), "cand_id", F.coalesce("y", F.lit(0)).alias("y")))), 1, cap).alias("l"))
    rows = truth.select("s1_id", F.size("ids").alias("t")).join(lists, "s1_id", "left").crossJoin(F.broadcast(thresholds))
    kept = F.filter("l", lambda x: -x["m"] >= F.col("pair"))
    passes = -F.get("l", F.lit(0))["m"] >= F.col("singleton")
    rows = rows.withColumn("k", F.when(passes, kept))
    n = F.coalesce(F.size("k"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    true_ = F.coalesce(F.size(F.filter("k", lambda x: x["y"] == 1)), F.lit(0))
    f = F.when((n == 0) & (F.col("t") == 0), 1.0).when(true_ <= 0, 0.0).otherwise((1 + BETA2) * true_ / (n + BETA2 * F.col("t")))
    return rows.withColumn("f", f).groupBy("g", "pair", "singleton").agg(F.avg("f").alias("f"))


def with_margins(scores: DataFrame, margins: tuple[float | None, ...] = MARGINS) -> DataFrame:
    """``grid_scores`` with the margin as a third axis, numbered in order.

    What is kept one to one is its candidate's best, so that no margin drops any of it and F is the same for all.
    """
    axis = F.posexplode(F.array(*[F.lit(m).cast("double") for m in margins])).alias("_m", "margin")
    return scores.select("*", axis).withColumn("g", (F.col("g") * len(margins) + F.col("_m")).cast("int")).drop("_m")


def tune(truth: DataFrame, scored: DataFrame) -> tuple[float, float, float]:
    """pair, singleton and F of the best grid row, coarse and then fine around it; of equals the first in order."""
    spark = truth.sparkSession
    best = grid_scores(truth, scored, grid(spark)).orderBy(F.round("f", 9).desc(), "g").first()
    near = lambda x: [round(x + 0.01 * k, 2) for k in range(-5, 6) if 0 <= x + 0.01 * k <= 1]
    fine = grid_scores(truth, scored, grid(spark, near(best.pair), near(best.singleton))).orderBy(F.round("f", 9).desc(), "g").first()
    return fine.pair, fine.singleton, fine.f


def unseen_country(tuned: tuple[float, float], left_out: list[tuple[float, float]], shift: float = 0.03) -> tuple[float, float]:
    """Thresholds for a country without labels: the mean of those tuned with a country left out, if their pair threshold is further than ``shift`` from the tuned one."""
    if not left_out:
        return tuned
    pair, single = (sum(x[k] for x in left_out) / len(left_out) for k in (0, 1))
    return (pair, single) if abs(pair - tuned[0]) > shift else tuned


def prefilter_recall(entities: DataFrame, pairs: DataFrame, blocked: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: the true pairs of ``entities``, the shares of them among the blocked and the kept candidates, and the difference. Shares of no pairs are 0."""
    flag = lambda df, c: df.select("s1_id", "cand_id").distinct().withColumn(c, F.lit(1))
    of = pairs.join(entities.select("s1_id"), "s1_id", "left_semi").select("s1_id", "cand_id").distinct()
    marked = of.join(flag(blocked, "_b"), ["s1_id", "cand_id"], "left").join(flag(kept, "_k"), ["s1_id", "cand_id"], "left")
    share = lambda c: F.count(c) / F.greatest(F.count("*"), F.lit(1))
    return marked.agg(F.count("*").alias("true_pairs"), share("_b").alias("blocking_recall"), share("_k").alias("prefilter_recall"), (share("_b") - share("_k")).alias("loss"))


def missed_rate(entities: DataFrame, pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """True pairs that were never candidates, by entity, in each country: the Poisson mean of the decoder."""
    missed = pairs.join(candidates.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_anti").groupBy("s1_id").agg(F.count("*").alias("m"))
    return entities.join(missed, "s1_id", "left").groupBy("country").agg((F.coalesce(F.sum("m"), F.lit(0)) / F.count("*")).alias("missed"))


def unlabelled_diagnostic(entities: DataFrame, predicted: DataFrame, singleton_rate: float = 0.0558, mean_matches: float = 3.461) -> DataFrame:
    """Predicted singleton rate and mean matches beside the expected ones."""
    counts = entities.join(predicted.groupBy("s1_id").agg(F.countDistinct("cand_id").alias("n")), "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(F.avg((F.col("n") == 0).cast("double")).alias("singleton_rate"), F.avg("n").alias("mean_matches")).withColumns({"expected_rate": F.lit(singleton_rate), "expected_matches": F.lit(mean_matches)})


def findings(output: DataFrame, entities: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """What is wrong with an output of id lists (source1_entity_id, matched_entity_ids): rule, source1_entity_id, detail.

    Rules: duplicate_row, repeated_id, self_match, bad_prefix, missing_entity, extra_entity, unknown_id (with ``known``
    entity_id), not_candidate (a warning, with ``candidates``).
    """
    from tessera.sources.io import id_list

    rows = output.select("source1_entity_id", F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))
    say = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), "source1_entity_id", detail.alias("detail"))
    each = rows.select("source1_entity_id", F.explode("ids").alias("id"))
    per = each.groupBy("source1_entity_id", "id").count()
    seen, wanted = rows.select("source1_entity_id").distinct(), entities.select("source1_entity_id").distinct()
    ok = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    out = say(rows.groupBy("source1_entity_id").count().where("count > 1"), "duplicate_row", F.col("count").cast("string"))
    parts = [
        say(per.where("count > 1"), "repeated_id", F.col("id")),
        say(per.where(F.col("id") == F.col("source1_entity_id")), "self_match", F.col("id")),
        say(per.where(~ok), "bad_prefix", F.col("id")),
        say(wanted.join(seen, "source1_entity_id", "left_anti"), "missing_entity", F.lit("")),
        say(seen.join(wanted, "source1_entity_id", "left_anti"), "extra_entity", F.lit("")),
    ]
    if known is not None:
        parts.append(say(per.join(known.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti"), "unknown_id", F.col("id")))
    if candidates is not None:
        pairs = candidates.select("source1_entity_id", F.explode(id_list("candidate_entity_ids")).alias("id")).distinct()
        parts.append(say(per.join(pairs, ["source1_entity_id", "id"], "left_anti"), "not_candidate", F.col("id")))
    for p in parts:
        out = out.unionByName(p)
    return out
