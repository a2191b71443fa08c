"""The engine's queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import blocking, corpus, decide, evaluate, models, pairs, profile, splits
from tessera.operators.records import dense_text, normalised, pair_text, records, table, true_pairs, truth_lists
from tessera.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where("source = 1").select(F.col("entity_id").alias("s1_id"), "country")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return truth_lists(entities(spark, sf).select("s1_id"), true_pairs(spark, sf))


def norm(spark: SparkSession, sf: str) -> DataFrame:
    return normalised(records(spark, sf))


def candidates(spark: SparkSession, sf: str, cap: int = 200) -> DataFrame:
    """Pairs that share a lower-cased name word held by at most ``cap`` records of a pool."""
    r = records(spark, sf)
    keys = F.array_distinct(X.tokens(F.lower("name")))
    return blocking.key_arm(r.where("source = 1"), r.where("source > 1"), keys, cap)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates with jn, ja (word Jaccard of names and addresses) and p_match; word sets are made once a record."""
    return _scored_by_key(spark, sf).drop("k")


def _scored_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """``scored`` with k, the least key that both records have."""
    r = _written(records(spark, sf))
    wn, wa = (F.array_distinct(X.tokens(F.lower(c))) for c in ("name", "address"))
    both = blocking.key_pairs(r.where("source = 1"), r.where("source > 1"), wn, 200, {"country": F.col("country"), "name": F.col("name"), "addr": F.col("address"), "wn": wn, "wa": wa})
    jn, ja = S.jaccard_of_sets(F.col("s_wn"), F.col("c_wn"), 0.0), S.jaccard_of_sets(F.col("s_wa"), F.col("c_wa"), 0.0)
    rows = both.select("s1_id", "cand_id", "cand_source", F.col("s_country").alias("country"), "s_name", "c_name", "s_addr", "c_addr", jn.alias("jn"), ja.alias("ja"), "k")
    return rows.withColumn("p_match", F.round(0.4 * F.col("jn") + 0.6 * F.col("ja"), 6))


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return decide.decide(scored(spark, sf)).select("s1_id", "cand_id", "cand_source", "country", "p_match")


# sources and sinks


@query
def explode_ground_truth(spark, sf):
    lists = truth(spark, sf).select(F.col("s1_id").alias("source1_entity_id"), F.array_join("ids", " , ").alias("matched_entity_ids"))
    return io.explode_truth(lists)


@query
def source_prefix(spark, sf):
    return records(spark, sf).groupBy(io.source_prefix("entity_id").alias("prefix")).agg(F.count("*").alias("n"))


@query
def tsv_round_trip(spark, sf):
    r = records(spark, sf).select("entity_id", F.col("name").alias("business_name"), F.when(F.col("address") != "", F.col("address")).alias("business_address"), "country")
    path = _folder(spark)
    r.write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")
    return io.read_tsv(spark, path)


@query
def partitioned_scan(spark, sf):
    path = _folder(spark)
    io.write_partitioned(records(spark, sf).select("entity_id", "name", "source", "country"), path, "source", "country")
    return spark.read.parquet(path).where("source = 2 and country = 'fr'").select("entity_id", "name")


@query
def first_rows(spark, sf):
    return io.first_rows(records(spark, sf).select("entity_id", "country"), 100, "entity_id")


@query
def id_list_output(spark, sf):
    e = entities(spark, sf).select(F.col("s1_id").alias("source1_entity_id"))
    return io.id_lists(e, decided(spark, sf), order=-F.col("p_match"))


def _folder(spark: SparkSession) -> str:
    """A new path for a written table: in the shared folder that the session names, else in the warehouse, which all nodes share, too."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` written once and read again, for plans that start from them several times."""
    path = _folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


# profiling


@query
def match_cardinality(spark, sf):
    return profile.match_cardinality(entities(spark, sf).select("s1_id"), true_pairs(spark, sf))


@query
def exclusivity(spark, sf):
    return profile.exclusivity(true_pairs(spark, sf))


@query
def cross_partition_pairs(spark, sf):
    customers = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("entity_id"), F.col("c_nationkey").alias("n_nationkey"))
    suppliers = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("n_nationkey"))
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country")))  # the nations are a fixed list
    sides = customers.unionByName(suppliers).join(nation, "n_nationkey", "left")
    orders = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs_ = orders.select(F.concat(F.lit("C"), "o_custkey").alias("s1_id"), F.concat(F.lit("S"), "l_suppkey").alias("cand_id")).distinct()
    return profile.cross_partition_pairs(pairs_, sides)


@query
def source_sizes(spark, sf):
    return profile.source_sizes(records(spark, sf))


@query
def chain_names(spark, sf):
    return profile.chain_names(table(spark, sf, "part").select(F.col("p_name").alias("name")), 0.9)


@query
def common_names(spark, sf):
    return profile.common_names(records(spark, sf))


@query
def partition_values(spark, sf):
    return profile.partition_values(records(spark, sf))


@query
def missing_partition(spark, sf):
    return profile.missing_partition(records(spark, sf).withColumn("country", F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("country"))))


@query
def postal_house_coverage(spark, sf):
    return profile.coverage(records(spark, sf), postal=profile.has_postal(F.col("address")), house=profile.has_house(F.col("address")))


@query
def script_shares(spark, sf):
    return profile.script_shares(norm(spark, sf))


@query
def name_duplication(spark, sf):
    return profile.name_duplication(records(spark, sf))


@query
def source_asymmetry(spark, sf):
    return profile.source_asymmetry(true_pairs(spark, sf), records(spark, sf), lambda a, b: F.round(S.jaro_winkler(a, b), 6))


@query
def matches_by_source(spark, sf):
    return profile.matches_by_source(true_pairs(spark, sf))


# text


def _docs(spark, sf):
    return records(spark, sf)


@query
def basic_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.basic_clean("text").alias("clean"), X.strip_junk("text").alias("junk_off"))


@query
def repeated_words(spark, sf):
    w = F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", X.joined(X.once_in_a_row(w)).alias("once"), (F.size(X.once_in_a_row(w)) < F.size(w)).cast("int").alias("changed"))


@query
def domain_extract(spark, sf):
    host = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"/.*$", "")
    return table(spark, sf, "pages").select("page_id", X.domain_parts(F.concat(host, F.when(F.col("page_id") % 2 == 0, " shop").otherwise(""))).alias("d")).select("page_id", "d.name", "d.domain", "d.from_domain")


@query
def expand_abbrev(spark, sf):
    r = records(spark, sf)
    return r.select("entity_id", X.expanded(X.tokens(F.lower("name")), X.SEED_NAMES).alias("name_x"), X.expanded(X.tokens(F.lower("address")), X.SEED_ADDRESSES).alias("address_x"))


@query
def legal_split(spark, sf):
    r = records(spark, sf).withColumn("w", F.concat(X.tokens(F.lower("name")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("private"), F.lit("limited"))).otherwise(F.array(F.lit("sa")))))
    return r.select("entity_id", X.split_legal(F.col("w")).alias("l")).select("entity_id", X.joined(F.col("l.core")).alias("core"), "l.suffix")


@query
def acronym_sorted(spark, sf):
    w = X.tokens(F.lower("name"))
    return records(spark, sf).select("entity_id", X.acronym(w).alias("acronym"), X.joined(F.array_sort(w)).alias("name_sorted"))


def _address(c: str = "doc_id"):
    """Addresses with landmarks, house numbers and postal codes in turn, as the documents hold few."""
    k = F.col(c) % 5
    lead = F.when(k == 0, "h.no 12/b ").when(k == 1, "105 ").when(k == 2, "plot no 7-c, ").otherwise("")
    tail = F.when(k == 0, ", near the mill, pune 400 001").when(k == 1, " opp. city hall, TX 75001").when(k == 2, ", in front of station, 560001, 12345").otherwise("")
    return F.concat(lead, F.lower("address"), tail)


@query
def landmarks(spark, sf):
    return records(spark, sf).select("entity_id", X.landmarks(_address()).alias("l")).select("entity_id", "l.rest", "l.found")


@query
def postal(spark, sf):
    return records(spark, sf).select("entity_id", X.postal(_address()).alias("p")).select("entity_id", "p.code", "p.prefix", "p.rest")


@query
def house_number(spark, sf):
    r = records(spark, sf).select("entity_id", X.house(_address()).alias("h"), X.house(_address(), strict=True).alias("g"))
    return r.select("entity_id", "h.house", "h.rest", F.col("g.house").alias("strict_house"))


@query
def locality_street(spark, sf):
    return norm(spark, sf).select("entity_id", "locality_tokens", "state_code", "street_tokens", "all_numbers")


@query
def normalized_records(spark, sf):
    return norm(spark, sf)


@query
def normalized_by_country(spark, sf):
    return norm(spark, sf).groupBy("country").agg(F.count("*").alias("n"), F.sum("address_missing").alias("no_address"), F.sum("postal_missing").alias("no_postal"), F.sum("name_had_repeat").alias("repeats"), F.countDistinct("core_name").alias("names"))


@query
def phonetic_key(spark, sf):
    return records(spark, sf).select("entity_id", X.phonetic(X.tokens(F.regexp_replace(F.lower("name"), "[^a-z ]", ""))).alias("phon"))


@query
def trigram_sets(spark, sf):
    return records(spark, sf).select("entity_id", F.size(X.trigrams("name")).alias("n"), F.array_sort(X.trigrams("name")).alias("grams"))


@query
def record_texts(spark, sf):
    return norm(spark, sf).select("entity_id", dense_text().alias("dense_text"), pair_text("core_name", "address_expanded", "name", "name_script").alias("pair_text"))


# corpus statistics and mining


@query
def token_idf(spark, sf):
    return corpus.token_idf(norm(spark, sf), X.tokens("core_name"))


@query
def name_freq(spark, sf):
    return corpus.name_frequency(norm(spark, sf))


def _mined(spark, sf):
    r = records(spark, sf).select("entity_id", X.tokens(F.lower(F.concat_ws(" ", "name", "address"))).alias("w"))
    both = pairs.sided(true_pairs(spark, sf), r)
    return corpus.abbreviation_pairs(both, F.col("s.w"), F.col("c.w"))


@query
def abbrev_pairs(spark, sf):
    return _mined(spark, sf)


@query
def abbrev_accept(spark, sf):
    return corpus.accepted(_mined(spark, sf), 2, 0.5)


@query
def abbrev_unsup(spark, sf):
    return corpus.accepted(corpus.slot_pairs(records(spark, sf), X.tokens(F.lower("name")), 3), 1, 0.34, ("country",))


@query
def abbrev_merge(spark, sf):
    unsup = corpus.accepted(corpus.slot_pairs(records(spark, sf), X.tokens(F.lower("name")), 3).groupBy("short", "long").agg(F.sum("n").alias("n")), 1, 0.34)
    return corpus.merged([corpus.seed(spark), unsup, corpus.accepted(_mined(spark, sf), 2, 0.5)])


# splits


def _counted(spark, sf):
    counts = true_pairs(spark, sf).groupBy("s1_id").agg(F.count("*").alias("n"))
    return entities(spark, sf).join(counts, "s1_id", "left").select(F.col("s1_id").alias("entity_id"), "country", F.coalesce("n", F.lit(0)).cast("int").alias("match_count"))


@query
def stratified_split(spark, sf):
    return splits.stratified(_counted(spark, sf))


@query
def split_subsample(spark, sf):
    return splits.stratified(_counted(spark, sf), subsample=0.5).groupBy("group").agg(F.count("*").alias("n"))


@query
def split_members(spark, sf):
    return splits.members(splits.stratified(_counted(spark, sf)), "V", "en")


@query
def entity_holdout(spark, sf):
    return splits.holdout(scored(spark, sf), "s1_id").select("s1_id", "cand_id", "held")


@query
def split_halves(spark, sf):
    return splits.halves(entities(spark, sf), "s1_id").select("s1_id", "half", "early")


# blocking


def _arm(spark, sf, keys, cap):
    n = norm(spark, sf)
    return blocking.key_arm(n.where("source = 1"), n.where("source > 1"), keys, cap)


@query
def key_arm_locality(spark, sf):
    return _arm(spark, sf, blocking.locality_keys(), 200)


@query
def key_arm_house(spark, sf):
    return _arm(spark, sf, blocking.house_keys(), 200)


@query
def key_arm_acronym(spark, sf):
    return _arm(spark, sf, blocking.acronym_keys(), 100)


@query
def capped_key_join(spark, sf):
    return candidates(spark, sf)


def _tfidf(n, column, terms, max_df, k):
    return blocking.tfidf_topk(n.select("entity_id", "source", "country", column), column, terms, max_df, k)


@query
def tfidf_name_topk(spark, sf):
    return _tfidf(_written(norm(spark, sf).select("entity_id", "source", "country", "core_name")), "core_name", blocking.char_grams, 0.1, 10).select("s1_id", "cand_id", "cand_source", F.round("score", 6).alias("score"), "rank")


@query
def tfidf_addr_topk(spark, sf):
    return _tfidf(_written(norm(spark, sf).select("entity_id", "source", "country", "address_expanded")), "address_expanded", blocking.word_grams, 0.1, 10).select("s1_id", "cand_id", "cand_source", F.round("score", 6).alias("score"), "rank")


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("part"))
    return v.where("id % 3 = 0"), v.where("id % 3 <> 0")


@query
def dense_knn_exact(spark, sf):
    return blocking.dense_knn(*_vectors(spark, sf)).select("s1_id", "cand_id", F.round("score", 6).alias("score"), "rank")


@query
def dense_knn_ivf(spark, sf):
    q, p = _vectors(spark, sf)
    return blocking.dense_ivf(q, p)


def _union(spark, sf):
    n = _written(norm(spark, sf).select("entity_id", "source", "country", "core_name", "address_expanded", "locality_tokens", "postal_code", "house_number", "street_tokens", "acronym", "postal_prefix3"))
    q, p = n.where("source = 1"), n.where("source > 1")
    arms = [
        blocking.arm_rows(_tfidf(n, "core_name", blocking.char_grams, 0.1, 10), "name"),
        blocking.arm_rows(_tfidf(n, "address_expanded", blocking.word_grams, 0.1, 10), "address"),
        blocking.arm_rows(blocking.key_arm(q, p, blocking.locality_keys(), 200, once=False), "key_locrare_hit"),
        blocking.arm_rows(blocking.key_arm(q, p, blocking.house_keys(), 200, once=False), "key_house_hit"),
        blocking.arm_rows(blocking.key_arm(q, p, blocking.acronym_keys(), 100, once=False), "key_acr_hit"),
    ]
    return blocking.union_and_cap(arms)


@query
def candidate_union(spark, sf):
    u = _union(spark, sf)
    return u.select(*[F.round(c, 6).alias(c) if c.endswith("_score") else F.col(c) for c in u.columns])


@query
def blocking_recall(spark, sf):
    return blocking.recall(entities(spark, sf), true_pairs(spark, sf), candidates(spark, sf))


# similarities


def _ascii(c: str):
    """Without other characters, as the SQL functions that these queries are held against count bytes."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


@query
def jaro_winkler(spark, sf):
    return scored(spark, sf).select("s1_id", "cand_id", F.round(S.jaro_winkler(_ascii("s_name"), _ascii("c_name")), 6).alias("jw"))


@query
def levenshtein_sim(spark, sf):
    return scored(spark, sf).select("s1_id", "cand_id", F.round(S.levenshtein(_ascii("s_name"), _ascii("c_name")), 6).alias("lev"))


@query
def trigram_jaccard(spark, sf):
    return scored(spark, sf).select("s1_id", "cand_id", F.round(S.jaccard(X.trigrams("s_name"), X.trigrams("c_name"), 1.0), 6).alias("char3"))


@query
def token_jaccard(spark, sf):
    return scored(spark, sf).select("s1_id", "cand_id", F.round("jn", 6).alias("stage_b"), F.round(S.jaccard(X.tokens("s_addr"), X.tokens("c_addr"), 1.0), 6).alias("stage_a"))


@query
def idf_jaccard(spark, sf):
    r = records(spark, sf).select("entity_id", "country", X.tokens(F.lower("name")).alias("w_core"), F.array().cast("array<string>").alias("w_street"))
    idf = corpus.token_idf(r, F.col("w_core"))
    both = pairs.sided(candidates(spark, sf), pairs.with_idf(r, idf))
    weights = F.map_concat(F.map_filter("s.w_idf", lambda k, v: ~F.map_contains_key("c.w_idf", k)), F.col("c.w_idf"))
    return both.select("s1_id", "cand_id", F.round(S.weighted_jaccard(F.col("s.w_core"), F.col("c.w_core"), weights), 6).alias("idf_jac"))


@query
def pair_flags(spark, sf):
    both = pairs.sided(candidates(spark, sf), pairs.prepared(norm(spark, sf)))
    sc = lambda n: (F.col(f"s.{n}"), F.col(f"c.{n}"))
    return both.select(
        "s1_id", "cand_id", S.equal(*sc("core_name")).alias("core_eq"), S.equal(*sc("name_sorted")).alias("sorted_eq"), S.equal(*sc("house_number")).alias("house_eq"), S.equal(*sc("postal_code")).alias("postal_eq"),
        S.acronym_match(*sc("acronym"), *sc("w_all")).alias("acronym"), S.legal_state(*sc("legal_suffix")).alias("legal"), F.size(F.array_intersect(*sc("w_nums"))).alias("nums_shared"), F.size(F.array_intersect(*sc("w_land"))).alias("landmarks_shared"),
    )


@query
def pair_cosine(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    a, b = v.select("vec_id", F.col("embedding").alias("a")), v.select((F.col("vec_id") - 7).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id", "left").select("vec_id", F.round(S.dot(F.col("a"), F.col("b")), 5).alias("cos"))


@query
def token_ratios(spark, sf):
    s = scored(spark, sf)
    return s.select("s1_id", "cand_id", S.token_sort_ratio("s_name", "c_name").alias("sort"), S.token_set_ratio("s_name", "c_name").alias("set"), S.partial_ratio("s_name", "c_name").alias("partial"))


# features


def _ranked(spark, sf):
    return scored(spark, sf).select("s1_id", "cand_id", "cand_source", F.col("p_match").alias("f_rerank"), F.round("jn", 6).alias("f_stage_a"))


@query
def stage_a_features(spark, sf):
    return pairs.stage_a(candidates(spark, sf), norm(spark, sf))


@query
def stage_a_set_features(spark, sf):
    f = pairs.stage_a(candidates(spark, sf), norm(spark, sf))
    return f.select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in ("f_name_char3", "f_nums_jac", "f_loc_overlap")], "f_house_eq", "f_postal_eq")


@query
def stage_b_features(spark, sf):
    n = _written(norm(spark, sf))
    p = _written(_scored_by_key(spark, sf).select("s1_id", "cand_id", "cand_source", F.col("p_match").alias("stage_a_score"), "k"))
    return pairs.stage_b(p, n, corpus.token_idf(n, X.tokens("core_name")), corpus.name_frequency(n), by="k", complete=True)


@query
def listwise_s1(spark, sf):
    f = pairs.listwise(_ranked(spark, sf))
    return f.select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in f.columns if c.startswith(("f_rank_by", "f_rerank_", "f_stagea"))])


@query
def listwise_candidate(spark, sf):
    f = pairs.listwise(_ranked(spark, sf))
    return f.select("s1_id", "cand_id", "f_cand_competitors", "f_cand_best_rerank_for_others", F.round("f_cand_gap_to_best", 6).alias("f_cand_gap_to_best"), "f_cand_rank_among_competitors")


@query
def support_feature(spark, sf):
    return pairs.support(_ranked(spark, sf)).select("s1_id", "cand_id", "f_support")


@query
def context_features(spark, sf):
    f = pairs.context(scored(spark, sf))
    return f.select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in f.columns if c.startswith("c_") and c not in ("c_name", "c_addr")])


@query
def anchor_pairs(spark, sf):
    return pairs.anchors(scored(spark, sf)).select("s1_id", "cand_id", "an_id", "an_source", "an_p", "an_is_top")


@query
def anchor_features(spark, sf):
    return pairs.anchor_features(pairs.anchors(scored(spark, sf)), norm(spark, sf))


@query
def top_candidates(spark, sf):
    return models.top_by_score(scored(spark, sf).select("s1_id", "cand_id", F.col("p_match").alias("stage_a_score")), 3)


@query
def candidate_lists(spark, sf):
    """Each entity's best candidates as one list, the best first."""
    kept = top_candidates(spark, sf)
    e = entities(spark, sf).select(F.col("s1_id").alias("source1_entity_id"))
    return io.id_lists(e, kept, "candidate_entity_ids", order=-F.col("stage_a_score"))


@query
def prefilter_recall(spark, sf):
    return evaluate.prefilter_recall(entities(spark, sf), true_pairs(spark, sf), candidates(spark, sf), top_candidates(spark, sf))


@query
def hard_negatives(spark, sf):
    p = pairs.labelled(scored(spark, sf).select("s1_id", "cand_id", F.col("p_match").alias("stage_a_score")), true_pairs(spark, sf))
    return models.hard_negatives(p, 2).select("s1_id", "cand_id", "y")


# models


_FEATURES = ["jn", "ja", "jw"]


def _training(spark, sf):
    s = scored(spark, sf).withColumn("jw", S.jaro_winkler("s_name", "c_name"))
    return pairs.labelled(s.select("s1_id", "cand_id", "cand_source", "country", *_FEATURES), true_pairs(spark, sf))


@query
def gbt_scores(spark, sf):
    rows = splits.holdout(_training(spark, sf), "s1_id", 0.3)
    model = models.train(rows.where("held = 0"), _FEATURES, trees=10, depth=3)
    return models.score(model, rows, _FEATURES).select("s1_id", "cand_id", "y", "held", "p_match")


@query
def isotonic_calibration(spark, sf):
    rows = pairs.labelled(scored(spark, sf), true_pairs(spark, sf)).select("s1_id", "cand_id", "p_match", "y")
    return models.calibrate(rows, rows).select("s1_id", "cand_id", "y", "p_cal")


@query
def efm_decode(spark, sf):
    rows = pairs.labelled(scored(spark, sf), true_pairs(spark, sf)).select("s1_id", "cand_id", "p_match", "y")
    cal = models.calibrate(rows, rows).select("s1_id", "cand_id", F.col("p_cal").alias("p_match"))
    return decide.decode(cal, 0.05)


@query
def stage_c_scores(spark, sf):
    """Third-stage scores from the listwise columns."""
    p = scored(spark, sf).select("s1_id", "cand_id", "cand_source", "p_match")
    rows = pairs.with_gaps(_written(pairs.labelled_context(p, true_pairs(spark, sf)).drop("cand_source")))  # training and both decisions read it
    columns = ["c_p", "c_s1_max", "c_s1_gap", "c_s1_rank", "c_s1_sum", "c_s1_n50", "c_s1_n80", "c_s1_2nd", "c_s1_gap12", "c_other_src_max", "c_cand_max", "c_cand_gap", "c_cand_n", "c_cand_rank"]
    new, _ = models.third_stage(rows, columns, truth(spark, sf), trees=5, depth=3)
    return new.select("s1_id", "cand_id", "p_match", "p_new")


@query
def missed_rate(spark, sf):
    m = evaluate.missed_rate(entities(spark, sf), true_pairs(spark, sf), candidates(spark, sf))
    return m.select("country", F.round("missed", 6).alias("missed"))


@query
def abbrev_dictionary(spark, sf):
    slots = corpus.slot_pairs(records(spark, sf), X.tokens(F.lower("name")), 3)
    return corpus.dictionary(spark, X.SEED_NAMES, _mined(spark, sf), slots, 2, 0.5)


# decision and evaluation


@query
def one_to_one(spark, sf):
    return decide.one_to_one(scored(spark, sf), ("country",)).select("s1_id", "cand_id", "p_match")


@query
def decide_full(spark, sf):
    return decided(spark, sf).select("s1_id", "cand_id", "p_match")


@query
def decide_margin(spark, sf):
    return decide.decide(scored(spark, sf), 0.2, 0.3, margin=0.1).select("s1_id", "cand_id", "p_match")


@query
def per_partition_thresholds(spark, sf):
    t = spark.createDataFrame([("en", 0.4, 0.6), ("fr", 0.55, 0.55)], "country string, pair double, singleton double")
    return decide.decide_by_country(scored(spark, sf), t).select("s1_id", "cand_id", "p_match")


@query
def entity_fbeta(spark, sf):
    return evaluate.entity_scores(truth(spark, sf), decided(spark, sf)).select("s1_id", F.round("f", 6).alias("f"))


@query
def macro_fbeta(spark, sf):
    m = evaluate.macro(evaluate.entity_scores(truth(spark, sf), decided(spark, sf)))
    return m.select(*[F.round(c, 6).alias(c) if c.startswith(("f", "e", "m")) and c != "entities" else F.col(c) for c in m.columns])


@query
def threshold_grid(spark, sf):
    g = evaluate.with_margins(evaluate.grid_scores(truth(spark, sf), scored(spark, sf), evaluate.grid(spark)))
    return g.select("g", "pair", "singleton", "margin", F.round("f", 6).alias("f"))


@query
def unlabelled_diagnostic(spark, sf):
    d = evaluate.unlabelled_diagnostic(entities(spark, sf).select("s1_id"), decided(spark, sf))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query
def validate_output(spark, sf):
    """An output that is spoiled on purpose: every rule has findings."""
    base = id_list_output(spark, sf)
    k = F.substring("source1_entity_id", -2, 2).cast("int") % 10
    ids = F.concat_ws(",", F.when(F.col("matched_entity_ids") != "", F.col("matched_entity_ids")), F.when(k == 1, F.col("source1_entity_id")), F.when(k == 2, F.lit("S2-1,S2-1")), F.when(k == 3, F.lit("X9")))
    rows = base.select("source1_entity_id", ids.alias("matched_entity_ids"), k.alias("k"))
    spoiled = rows.where("k <> 4").unionByName(rows.where("k = 5")).unionByName(rows.where("k = 6").withColumn("source1_entity_id", F.concat(F.lit("S1-x"), "source1_entity_id")))
    e = entities(spark, sf).select(F.col("s1_id").alias("source1_entity_id"))
    return evaluate.findings(spoiled.drop("k"), e, records(spark, sf))
