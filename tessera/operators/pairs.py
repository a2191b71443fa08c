"""Pair features of the two matcher stages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import similarity as S
from tessera.functions import text as X

_BLOCK = ("dense_score", "name_tfidf_score", "addr_tfidf_score", "dense_rank", "name_tfidf_rank", "addr_tfidf_rank", "n_arms_hit", "key_locrare_hit", "key_house_hit", "key_acr_hit")


def prepared(records: DataFrame) -> DataFrame:
    """Records with their word arrays: computed once a record, before any pair repeats it."""
    name = F.when(F.coalesce("core_name", F.lit("")) != "", F.col("core_name")).otherwise(X.text("name_roman"))
    lists = {"w_core": "core_name", "w_nums": "all_numbers", "w_loc": "locality_tokens", "w_street": "street_tokens", "w_land": "landmark_text"}
    return records.withColumns({"match_name": name} | {k: F.array_distinct(X.tokens(c)) for k, c in lists.items()} | {"w_all": X.tokens("core_name"), "g_core": X.trigrams("core_name"), "g_match": X.trigrams(name), "phon": X.phonetic(X.tokens("core_name"))})


def sided(pairs: DataFrame, records: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs with both records' attributes as structs s and c; of repeated ids one record counts. Absent records drop the pair, or with ``how`` left stay null."""
    one = records.dropDuplicates(["entity_id"])
    packed = one.select("entity_id", F.struct(*[c for c in one.columns if c != "entity_id"]).alias("r"))
    left, right = packed.select(F.col("entity_id").alias("s1_id"), F.col("r").alias("s")), packed.select(F.col("entity_id").alias("cand_id"), F.col("r").alias("c"))
    return pairs.join(left, "s1_id", how).join(right, "cand_id", how)


def stage_a(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Keys, the nine cheap features, and whatever blocking columns the pairs carry."""
    both = sided(pairs, prepared(records))
    sc = lambda n: (F.col(f"s.{n}"), F.col(f"c.{n}"))
    carried = [c for c in _BLOCK if c in pairs.columns]
    return both.select(
        "s1_id", "cand_id", "cand_source",
        S.jaro_winkler(*sc("match_name")).alias("f_name_jw"),
        S.token_sort_ratio(*sc("match_name")).alias("f_name_sort"),
        S.token_set_ratio(*sc("match_name")).alias("f_name_set"),
        S.token_set_ratio(*sc("address_expanded")).alias("f_addr_set"),
        S.jaccard(*sc("g_match"), 1.0).alias("f_name_char3"),
        S.jaccard(*sc("w_nums"), 1.0).alias("f_nums_jac"),
        S.jaccard(*sc("w_loc"), 1.0).alias("f_loc_overlap"),
        S.equal(*sc("house_number")).alias("f_house_eq"),
        S.equal(*sc("postal_code")).alias("f_postal_eq"),
        *carried,
    )


def idf_map(idf: DataFrame, words: Column, records: DataFrame) -> DataFrame:
    """entity_id and w_idf: the weights of the record's own words only, so that no map of the whole vocabulary travels."""
    each = records.select("entity_id", "country", F.explode(F.array_distinct(words)).alias("token")).join(idf, ["country", "token"])
    return each.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("w_idf"))


def with_idf(records: DataFrame, idf: DataFrame) -> DataFrame:
    """Prepared records with the weights of their name and street words."""
    own = idf_map(idf, F.concat("w_core", "w_street"), records)
    return records.join(own, "entity_id", "left").withColumn("w_idf", F.coalesce("w_idf", F.create_map().cast("map<string,double>")))


def listwise(scored: DataFrame) -> DataFrame:
    """The 17 features of a pair among the pairs of its entity and of its candidate. Needs f_rerank and f_stage_a."""
    s1, cand = Window.partitionBy("s1_id"), Window.partitionBy("cand_id")
    by_rerank, by_stage = s1.orderBy(F.col("f_rerank").desc(), "cand_id"), s1.orderBy(F.col("f_stage_a").desc(), "cand_id")
    whole = by_rerank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = Window.partitionBy("s1_id", "cand_source")
    best = F.max("f_rerank").over(s1)
    second = F.coalesce(F.nth_value("f_rerank", 2).over(whole), best)
    of_source = lambda f, s: F.when(F.col("cand_source") == s, f("f_rerank").over(own)).otherwise(-1.0)
    return scored.withColumns(
        {
            "f_rank_by_rerank": F.row_number().over(by_rerank),
            "f_rerank_max": best,
            "f_rerank_mean": F.avg("f_rerank").over(s1),
            "f_rerank_2nd": second,
            "f_rerank_gap_best": best - F.col("f_rerank"),
            "f_rerank_best_2nd_gap": best - second,
            "f_rerank_above_05": F.count_if(F.col("f_rerank") > 0.5).over(s1),
            "f_rank_by_stagea": F.row_number().over(by_stage),
            "f_stagea_max": F.max("f_stage_a").over(s1),
            "f_rerank_max_S2": of_source(F.max, "S2"),
            "f_rerank_mean_S2": of_source(F.avg, "S2"),
            "f_rerank_max_S3": of_source(F.max, "S3"),
            "f_rerank_mean_S3": of_source(F.avg, "S3"),
            "f_cand_competitors": F.count("*").over(cand),
            "f_cand_best_rerank_for_others": F.max("f_rerank").over(cand),
            "f_cand_gap_to_best": F.max("f_rerank").over(cand) - F.col("f_rerank"),
            "f_cand_rank_among_competitors": F.row_number().over(cand.orderBy(F.col("f_rerank").desc(), "s1_id")),
        }
    )


def support(scored: DataFrame) -> DataFrame:
    """The best score that an entity has in the other source, -1 without any."""
    w = Window.partitionBy("s1_id")
    best = lambda s: F.max(F.when(F.col("cand_source") == s, F.col("f_rerank"))).over(w)
    return scored.withColumn("f_support", F.coalesce(F.when(F.col("cand_source") == "S2", best("S3")).otherwise(best("S2")), F.lit(-1.0)))


#: The features of stage_b before those of listwise, in their order.
_FEATURES_B = (
    "f_name_jw_core", "f_name_jw_exp", "f_name_lev", "f_name_sort", "f_name_set", "f_name_partial",
    "f_name_char3", "f_name_word_jac", "f_name_idf_jac", "f_name_core_eq", "f_name_sorted_eq", "f_domain_match",
    "f_name_phon_jw", "f_name_phon_set", "f_name_phon_eq", "f_acronym_match", "f_legal_state", "f_expansion_changed_s",
    "f_expansion_changed_c", "f_romanized_used", "f_script_same", "f_postal_eq", "f_postal_prefix_eq", "f_house_eq",
    "f_nums_jac", "f_nums_shared", "f_street_idf_jac", "f_loc_overlap", "f_addr_jw", "f_addr_set",
    "f_landmark_overlap", "f_addr_missing_s", "f_addr_missing_c", "f_postal_missing_s", "f_postal_missing_c", "f_house_missing_s",
    "f_house_missing_c", "f_dense_score", "f_dense_cos", "f_stage_a", "f_rerank", "f_dense_rank",
    "f_name_tfidf_rank", "f_addr_tfidf_rank", "f_n_arms_hit", "f_cand_source_s2", "f_name_freq", "f_name_freq_log",
    "f_s1_idf_sum",
)


#: What stage_b reads of a record.
_TEXTS = ("core_name", "name_expanded", "name_sorted", "name_domain", "phon", "acronym", "initials", "legal_suffix", "name_script", "postal_code", "postal_prefix3", "house_number", "address_expanded")
_NONE = "\0"  # a missing script
_LISTS = ("g_core", "w_core", "w_nums", "w_loc", "w_street", "w_land")
_FLAGS = ("expansion_changed_name", "romanization_ok", "address_missing", "postal_missing", "house_number_missing")
#: Its columns of a pair, in the order of the features.
_COMPARED = {
    "double": ("f_name_jw_core", "f_name_jw_exp", "f_name_lev", "f_name_sort", "f_name_set", "f_name_partial", "f_name_char3", "f_name_word_jac", "f_name_idf_jac", "f_name_phon_jw", "f_name_phon_set", "f_nums_jac", "f_street_idf_jac", "f_loc_overlap", "f_addr_jw", "f_addr_set", "f_s1_idf_sum"),
    "int": ("f_name_core_eq", "f_name_sorted_eq", "f_domain_match", "f_name_phon_eq", "f_acronym_match", "f_legal_state", "f_expansion_changed_s", "f_expansion_changed_c", "f_romanized_used", "f_script_same", "f_postal_eq", "f_postal_prefix_eq", "f_house_eq", "f_nums_shared", "f_landmark_overlap", "f_addr_missing_s", "f_addr_missing_c", "f_postal_missing_s", "f_postal_missing_c", "f_house_missing_s", "f_house_missing_c"),
    "long": ("f_name_freq",),
}


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The members of a column's lists, or the entries of its maps, and where each row's begin and end."""
    chunk = column.combine_chunks()
    ends = chunk.offsets.to_numpy()
    values = chunk.keys if pa.types.is_map(chunk.type) else chunk.values
    return values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]


def _slice_of(table: pa.Table, rows_s: np.ndarray, rows_c: np.ndarray) -> dict[str, np.ndarray]:
    """Features of pairs of records, which two arrays of rows name; every text is read once."""
    records = {c: table[c].to_pylist() for c in _TEXTS}
    out: dict[str, np.ndarray] = {}
    number: dict[str, np.ndarray] = {}
    texts: dict[str, list[str]] = {}
    at: dict[str, int] = {}
    for c in _TEXTS:
        own: dict[str, int] = at if c in ("acronym", "initials") else {}
        number[c] = np.fromiter((own.setdefault(x, len(own)) for x in records[c]), np.int64, len(records[c]))
        texts[c] = list(own)

    def sides(c: str) -> tuple[np.ndarray, np.ndarray]:
        return number[c][rows_s], number[c][rows_c]

    def there(c: str, value: str = "") -> np.ndarray:
        return np.fromiter((x != value for x in texts[c]), bool, len(texts[c]))

    def by_text(c: str, measures: dict[str, Callable[[list[str], np.ndarray, np.ndarray], np.ndarray]]) -> None:
        x, y = sides(c)
        n = len(texts[c])
        pair, place = np.unique(x * n + y, return_inverse=True)
        x, y = np.divmod(pair, n)
        for f, measure in measures.items():
            out[f] = measure(texts[c], x, y)[place]

    jw = lambda t, x, y: S.jaro_winklers(S.Texts(t), x, y)
    by_set = lambda t, x, y: S.token_sets(S.WordSets(t), x, y)

    def by_sort(t: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return S.ratios(S.Texts([" ".join(sorted(v.split())) for v in t]), x, y)

    def lev(t: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        one = S.Texts(t)
        longest = np.maximum(one.size[x], one.size[y])
        return np.where(longest == 0, 1.0, 1 - S.distances(one, x, y) / np.maximum(longest, 1))

    by_text("core_name", {"f_name_jw_core": jw, "f_name_lev": lev, "f_name_sort": by_sort, "f_name_set": by_set, "f_name_partial": lambda t, x, y: S.partials(S.Texts(t), t, x, y)})
    by_text("name_expanded", {"f_name_jw_exp": jw})
    by_text("phon", {"f_name_phon_jw": jw, "f_name_phon_set": by_set})
    by_text("address_expanded", {"f_addr_jw": jw, "f_addr_set": by_set})

    for f, c in {"f_name_core_eq": "core_name", "f_name_sorted_eq": "name_sorted", "f_domain_match": "name_domain", "f_name_phon_eq": "phon", "f_postal_eq": "postal_code", "f_postal_prefix_eq": "postal_prefix3", "f_house_eq": "house_number"}.items():
        x, y = sides(c)
        out[f] = (x == y) & there(c)[x]
    (a, b), (of_a, of_b), some = sides("acronym"), sides("initials"), np.fromiter((x != "" for x in at), bool, len(at))
    out["f_acronym_match"] = some[a] & ((a == b) | (a == of_b)) | some[b] & (b == of_a)
    (a, b), some = sides("legal_suffix"), there("legal_suffix")
    out["f_legal_state"] = np.where(~some[a] & ~some[b], 0, np.where(a == b, 1, np.where(~some[a] | ~some[b], 2, 3)))
    (a, b), other = sides("name_script"), there("name_script", "latin")
    out["f_script_same"] = (a == b) & there("name_script", _NONE)[a]
    flag = {c: (v[rows_s], v[rows_c]) for c in _FLAGS for v in [table[c].to_numpy()]}
    out["f_romanized_used"] = (flag["romanization_ok"][0] == 0) | (flag["romanization_ok"][1] == 0) | other[a] | other[b]
    for f, c in {"f_expansion_changed": "expansion_changed_name", "f_addr_missing": "address_missing", "f_postal_missing": "postal_missing", "f_house_missing": "house_number_missing"}.items():
        out[f"{f}_s"], out[f"{f}_c"] = flag[c]

    flat, ends = zip(*(_flat(table[c]) for c in (*_LISTS, "w_all", "w_idf")))
    codes = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy().astype(np.int64)
    codes = dict(zip((*_LISTS, "w_all", "w_idf"), np.split(codes, np.cumsum([len(x) for x in flat])[:-1])))
    ends = dict(zip(codes, ends))
    lists = {c: np.split(codes[c], ends[c][1:-1]) for c in _LISTS}
    for f, c, empty in (("f_name_char3", "g_core", 1.0), ("f_name_word_jac", "w_core", 0.0), ("f_nums_jac", "w_nums", 0.0), ("f_loc_overlap", "w_loc", 0.0), ("f_landmark_overlap", "w_land", None)):
        size = np.fromiter(map(len, lists[c]), np.int64, len(lists[c]))
        shared = S.shared(lists[c], rows_s, rows_c)
        union = size[rows_s] + size[rows_c] - shared
        if c == "w_nums":
            out["f_nums_shared"] = shared
        out[f] = shared if empty is None else np.where(union == 0, empty, shared / np.maximum(union, 1))
    row = {c: np.repeat(np.arange(len(table)), np.diff(ends[c])) for c in codes}
    width = max((int(x.max(initial=0)) for x in codes.values()), default=0) + 1
    entry, weight = row["w_idf"] * width + codes["w_idf"], np.append(table["w_idf"].combine_chunks().items.to_numpy(zero_copy_only=False)[: len(codes["w_idf"])], np.nan)
    order = np.argsort(entry)

    def idf_of(c: str) -> list[np.ndarray]:
        """The weights of a record's words, nan without one."""
        at = np.searchsorted(entry, word := row[c] * width + codes[c], sorter=order)
        at = np.where(at < len(order), np.append(order, -1)[np.minimum(at, len(order))], -1)
        return np.where((np.append(entry, -1)[at] == word), weight[at], np.nan)

    both, idf = ([np.concatenate(x) for x in zip(*two)] for two in ((lists["w_core"], lists["w_street"]), [np.split(idf_of(c), ends[c][1:-1]) for c in ("w_core", "w_street")]))
    out["f_name_idf_jac"], out["f_street_idf_jac"] = S.weighted(both, idf, np.diff(ends["w_core"]), rows_s, rows_c)
    out["f_s1_idf_sum"] = np.bincount(row["w_all"], np.nan_to_num(idf_of("w_all")), len(table))[rows_s]
    out["f_name_freq"] = table["freq"].to_numpy()[rows_c]
    return out


#: Pairs of a block that are compared at a time.
_SLICE = 65_536


def _compared(schema: pa.Schema):
    """For the pairs of a block and the records that they name: the pairs with their features."""

    def run(pairs: pa.Table, records: pa.Table) -> pa.Table:
        ids = pa.concat_arrays(records["entity_id"].chunks) if len(records) else pa.array([], pa.string())
        s, c = (pc.index_in(pairs[x], value_set=ids) for x in ("s1_id", "cand_id"))
        pairs = pairs.append_column("_s", s).append_column("_c", c).filter(pc.and_(pc.is_valid(s), pc.is_valid(c)))
        pairs = pairs.take(pc.sort_indices(pairs, [("_s", "ascending"), ("_c", "ascending")]))
        parts = []
        for k in range(0, len(pairs), _SLICE):
            part = pairs.slice(k, _SLICE)
            rows_s, rows_c = (np.asarray(part[x]).astype(np.int64) for x in ("_s", "_c"))
            used, place = np.unique(np.concatenate([rows_s, rows_c]), return_inverse=True)
            found = _slice_of(records.take(pa.array(used)), place[: len(part)], place[len(part) :])
            parts.append(pa.table([pa.array(found[f.name]).cast(f.type) if f.name in found else part[f.name].cast(f.type) for f in schema], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def stage_b(pairs: DataFrame, records: DataFrame, idf: DataFrame, frequency: DataFrame, by: str = "s1_id", complete: bool = False) -> DataFrame:
    """Keys and the 66 features. ``pairs`` carry stage_a_score and, where they were run, rerank_score, dense_cos and blocking columns.

    ``idf``: (country, token, idf); ``frequency``: (country, name, freq). Country is never a feature.

    Pairs travel as ids to blocks by the column ``by``, records once to each block that names them: a column whose values
    few of a record's pairs differ in, as a common key, makes fewer copies of records than the entity does. Pairs without a
    record drop out before they are ranked; ``complete`` says that there are none.
    """
    if not complete:
        for c in ("cand_id", "s1_id"):
            pairs = pairs.join(records.select(F.col("entity_id").alias(c)), c, "left_semi")
    freq = frequency.select(F.col("country").alias("_c"), F.col("name").alias("_n"), "freq")
    one = with_idf(prepared(records.dropDuplicates(["entity_id"])), idf).join(freq, (F.col("country") == F.col("_c")) & (F.col("core_name") == F.col("_n")), "left")
    none = F.array().cast("array<string>")
    one = one.select("entity_id", *[(F.coalesce(c, F.lit(_NONE)) if c == "name_script" else X.text(c)).alias(c) for c in _TEXTS if c != "initials"], S.initials(F.col("w_all")).alias("initials"), *[F.coalesce(c, none).alias(c) for c in (*_LISTS, "w_all")], *[F.col(c).cast("int").alias(c) for c in _FLAGS], "w_idf", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))

    reranked, carried = "rerank_score" in pairs.columns, [c for c in ("dense_score", "dense_cos", "dense_rank", "name_tfidf_rank", "addr_tfidf_rank", "n_arms_hit") if c in pairs.columns]
    blocks = F.pmod(F.xxhash64(by), F.lit(4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    narrow = pairs.select("s1_id", "cand_id", "cand_source", blocks.alias("_block"), F.col("stage_a_score").alias("f_stage_a"), (F.coalesce("rerank_score", F.lit(-1.0)) if reranked else F.col("stage_a_score")).alias("f_rerank"), *carried)
    listed = listwise(narrow)
    again = {"f_rerank_gap_best": F.col("f_rerank_max") - F.col("f_rerank"), "f_rerank_best_2nd_gap": F.col("f_rerank_max") - F.col("f_rerank_2nd"), "f_cand_gap_to_best": F.col("f_cand_best_rerank_for_others") - F.col("f_rerank")}
    order = [c for c in listed.columns if c not in narrow.columns]
    sent = listed.drop(*again)
    named = narrow.select(F.col("_block").alias("_at"), F.explode(F.array("s1_id", "cand_id")).alias("entity_id")).distinct()
    there = one.join(named, "entity_id")
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in sent.schema if f.name != "_block"] + [f"{c} {kind}" for kind, cs in _COMPARED.items() for c in cs])
    schema = T.StructType.fromDDL(kinds)
    found = sent.groupBy("_block").cogroup(there.groupBy("_at")).applyInArrow(_compared(to_arrow_schema(schema)), schema)
    of = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in carried else F.lit(d)
    given = {
        "f_dense_score": of("dense_score", -1.0), "f_dense_cos": of("dense_cos", -2.0), "f_dense_rank": of("dense_rank", 99), "f_name_tfidf_rank": of("name_tfidf_rank", 99), "f_addr_tfidf_rank": of("addr_tfidf_rank", 99),
        "f_n_arms_hit": of("n_arms_hit", 0), "f_cand_source_s2": (F.col("cand_source") == "S2").cast("int"), "f_name_freq_log": F.log1p(F.col("f_name_freq").cast("double")),
    } | again
    return found.select("s1_id", "cand_id", "cand_source", *[given[c].alias(c) if c in given else F.col(c) for c in (*_FEATURES_B, *order)])


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with y: 1 if the pair is true."""
    return pairs.join(truth.select("s1_id", "cand_id").distinct().withColumn("y", F.lit(1)), ["s1_id", "cand_id"], "left").na.fill(0, ["y"])


def _by_candidate(scored: DataFrame) -> DataFrame:
    cand = Window.partitionBy("cand_id")
    p = F.col("p_match")
    return scored.withColumns({"c_cand_max": F.max(p).over(cand), "c_cand_n": F.count("*").over(cand), "c_cand_rank": F.row_number().over(cand.orderBy(p.desc(), "s1_id"))})


def _by_entity(rows: DataFrame) -> DataFrame:
    s1, p = Window.partitionBy("s1_id"), F.col("p_match")
    order = s1.orderBy(p.desc(), "cand_id")
    second = F.coalesce(F.nth_value("p_match", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    of = lambda s: F.max(F.when(F.col("cand_source") == s, p)).over(s1)
    return rows.withColumns(
        {
            "c_s1_max": F.max(p).over(s1), "c_s1_rank": F.row_number().over(order), "c_s1_sum": F.sum(p).over(s1), "c_s1_n50": F.count_if(p > 0.5).over(s1), "c_s1_n80": F.count_if(p > 0.8).over(s1), "c_s1_2nd": second,
            "c_other_src_max": F.coalesce(F.when(F.col("cand_source") == "S2", of("S3")).otherwise(of("S2")), F.lit(-1.0)),
        }
    )


def with_gaps(rows: DataFrame) -> DataFrame:
    """The columns of ``context`` that follow from the others of their row, which need not be kept."""
    p = F.col("p_match")
    return rows.withColumns({"c_p": p, "c_s1_gap": F.col("c_s1_max") - p, "c_s1_gap12": F.col("c_s1_max") - F.col("c_s1_2nd"), "c_cand_gap": F.col("c_cand_max") - p})


def context(scored: DataFrame) -> DataFrame:
    """The 14 listwise columns of the third stage, from p_match."""
    return with_gaps(_by_entity(_by_candidate(scored)))


def labelled_context(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """``labelled`` and ``context`` without its gaps, sorted by entity: pairs are shuffled once by candidate and once, with the true ones, by entity."""
    rows = _by_candidate(scored).withColumns({"y": F.lit(0), "_there": F.lit(True)})
    both = rows.unionByName(truth.select("s1_id", "cand_id", F.lit(1).alias("y")), allowMissingColumns=True).repartition("s1_id")
    marked = both.withColumn("y", F.max("y").over(Window.partitionBy("s1_id", "cand_id"))).where("_there").drop("_there")
    return _by_entity(marked)


def anchors(scored: DataFrame) -> DataFrame:
    """Pairs with their anchor: the entity's best other candidate (an_id, an_source, an_p; null without one), by one window, not a self-join."""
    w = Window.partitionBy("s1_id").orderBy(F.col("p_match").desc(), "cand_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(F.col("cand_id").alias("id"), F.col("cand_source").alias("source"), F.col("p_match").alias("p"))
    rows = scored.withColumns({"_row": row}).withColumns({"_one": F.first("_row").over(w), "_two": F.nth_value("_row", 2).over(w)})
    other = F.when(F.col("_one.id") == F.col("cand_id"), F.col("_two")).otherwise(F.col("_one"))
    return rows.withColumn("_a", other).select("*", F.col("_a.id").alias("an_id"), F.col("_a.source").alias("an_source"), F.col("_a.p").alias("an_p"), (F.col("_one.id") == F.col("cand_id")).cast("int").alias("an_is_top")).drop("_row", "_one", "_two", "_a")


def anchor_features(anchored: DataFrame, records: DataFrame) -> DataFrame:
    """The 13 similarities of a candidate to its anchor; missing ones are -1."""
    one = prepared(records).dropDuplicates(["entity_id"])
    packed = one.select("entity_id", F.struct(*[c for c in one.columns if c != "entity_id"]).alias("r"))
    both = anchored.join(packed.select(F.col("entity_id").alias("cand_id"), F.col("r").alias("c")), "cand_id", "left").join(packed.select(F.col("entity_id").alias("an_id"), F.col("r").alias("a")), "an_id", "left")
    ca = lambda n: (F.col(f"c.{n}"), F.col(f"a.{n}"))
    there = F.col("a").isNotNull() & F.col("c").isNotNull()
    value = {
        "an_name_jw": S.jaro_winkler(*ca("core_name")), "an_name_set": S.token_set_ratio(*ca("core_name")), "an_phon_jw": S.jaro_winkler(*ca("phon")),
        "an_addr_jw": S.jaro_winkler(*ca("address_expanded")), "an_addr_set": S.token_set_ratio(*ca("address_expanded")), "an_nums_set": S.token_set_ratio(*ca("all_numbers")),
        "an_house_eq": S.equal(*ca("house_number")).cast("double"),
        "an_dense_cos": S.dot(*ca("vector"), -1.0) if "vector" in records.columns else F.lit(-1.0),
        "an_same_src": (F.col("cand_source") == F.col("an_source")).cast("double"),
        "an_addr_empty_c": (X.text("c.address_expanded") == "").cast("double"), "an_addr_empty_a": (X.text("a.address_expanded") == "").cast("double"),
    }
    return both.select("s1_id", "cand_id", "cand_source", F.coalesce("an_p", F.lit(-1.0)).alias("an_p"), "an_is_top", *[F.when(there, v).otherwise(-1.0).alias(k) for k, v in value.items()])
