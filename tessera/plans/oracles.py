"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessera.functions import text as X
from tessera.plans import sql as Q

ORACLES: dict[str, str] = {}


def oracle(name: str, base: str, body: str) -> None:
    ORACLES[name] = f"WITH {base.strip()}{body}" if base and body.startswith(",") else f"WITH {base.strip()}\n{body}" if base else body


R, N, C, D = Q.RECORDS, Q.NORMALISED, Q.CANDIDATES, Q.DECIDED

# sources and sinks
oracle("explode_ground_truth", R, "SELECT s1_id AS source1_entity_id, cand_id AS matched_id FROM pairs")
oracle("source_prefix", R, "SELECT split_part(entity_id, '-', 1) AS prefix, count(*) AS n FROM records GROUP BY 1")
oracle("tsv_round_trip", R, "SELECT entity_id, nullif(name, '') AS business_name, nullif(address, '') AS business_address, country FROM records")
oracle("partitioned_scan", R, "SELECT entity_id, name FROM records WHERE source = 2 AND country = 'fr'")
oracle("first_rows", R, "SELECT entity_id, country FROM records ORDER BY entity_id LIMIT 100")
oracle("id_list_output", D, "SELECT e.s1_id AS source1_entity_id, coalesce(string_agg(d.cand_id, ',' ORDER BY d.p_match DESC, d.cand_id), '') AS matched_entity_ids FROM entities e LEFT JOIN decided d USING (s1_id) GROUP BY 1")

# profiling
oracle(
    "match_cardinality", R,
    """, c AS (SELECT s1_id, len(ids) AS n FROM truth), o AS (SELECT avg(n) AS mean, stddev_samp(n) AS std, min(n) AS least, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS p75, max(n) AS most, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END) AS singletons FROM c)
SELECT n, count(*) AS entities, any_value(mean) AS mean, any_value(std) AS std, any_value(least) AS least, any_value(p25) AS p25, any_value(median) AS median, any_value(p75) AS p75, any_value(most) AS most, any_value(singletons) AS singletons FROM c, o GROUP BY n""",
)
oracle("exclusivity", R, ", k AS (SELECT cand_id, count(DISTINCT s1_id) AS k FROM pairs GROUP BY 1) SELECT count(*) AS candidates, count(*) FILTER (k > 1) AS shared, avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) AS share FROM k")
oracle(
    "cross_partition_pairs", "",
    """SELECT DISTINCT 'C' || o_custkey AS s1_id, 'S' || l_suppkey AS cand_id, a.n_name AS s1_country, b.n_name AS cand_country FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey
WHERE NOT coalesce(a.n_name = b.n_name, false)""",
)
oracle("source_sizes", R, "SELECT country, count(*) FILTER (source = 1) AS s1, count(*) FILTER (source = 2) AS s2, count(*) FILTER (source = 3) AS s3, count(*) FILTER (source = 1) * count(*) FILTER (source > 1) AS naive_pairs FROM records GROUP BY 1")
oracle("chain_names", "", "WITH c AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1) SELECT name, n FROM c WHERE n >= (SELECT quantile_cont(n, 0.9) FROM c)")
oracle("common_names", R, ", c AS (SELECT source, name, count(*) AS n FROM records WHERE name IS NOT NULL GROUP BY 1, 2) SELECT source, name, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, name) AS INT) AS rank FROM c QUALIFY rank <= 25")
oracle("partition_values", R, "SELECT source, country, count(*) AS n FROM records GROUP BY 1, 2")
oracle("missing_partition", R, ", r AS (SELECT source, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 11 = 0 THEN NULL ELSE country END AS country FROM records) SELECT source, count(*) AS n, avg(CASE WHEN country IS NULL OR trim(country) = '' THEN 1.0 ELSE 0.0 END) AS missing, count(DISTINCT country) AS countries FROM r GROUP BY 1")
oracle(
    "postal_house_coverage", R,
    rf"""SELECT country, count(*) AS n, avg(CASE WHEN len(list_filter(regexp_extract_all(address, '\d+'), lambda d: length(d) BETWEEN 5 AND 6)) > 0 THEN 1.0 ELSE 0.0 END) AS postal,
avg(CASE WHEN regexp_matches(address, '{X.HOUSE_LABEL}') OR regexp_matches(address, '{Q.LEADING}') THEN 1.0 ELSE 0.0 END) AS house FROM records GROUP BY 1""",
)
oracle("script_shares", N, "SELECT country, name_script, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY country) AS share FROM norm GROUP BY 1, 2")
oracle("name_duplication", R, ", c AS (SELECT country, lower(trim(name)) AS k, count(*) AS n FROM records GROUP BY 1, 2) SELECT country, count(*) FILTER (n > 1) AS names, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows, coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS share FROM c GROUP BY 1")
oracle(
    "source_asymmetry", R,
    """, s AS (SELECT b.source, CASE WHEN a.name = '' AND b.name = '' THEN 0.0 ELSE round(jaro_winkler_similarity(lower(a.name), lower(b.name)), 6) END AS sim FROM pairs p JOIN records a ON a.entity_id = p.s1_id JOIN records b ON b.entity_id = p.cand_id)
SELECT source, count(*) AS n, avg(sim) AS mean, quantile_cont(sim, 0.25) AS p25, quantile_cont(sim, 0.5) AS p50, quantile_cont(sim, 0.75) AS p75 FROM s GROUP BY 1""",
)
oracle("matches_by_source", R, "SELECT split_part(cand_id, '-', 1) AS prefix, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM pairs GROUP BY 1")

# text
oracle("basic_clean", "", f"SELECT doc_id, {Q.clean('text')} AS clean, {Q._junk('text')} AS junk_off FROM documents")
oracle("repeated_words", R, f"SELECT doc_id, {Q.joined(Q.once('t'))} AS once, CAST(len({Q.once('t')}) < len(t) AS INT) AS changed FROM docs")
oracle(
    "domain_extract", "",
    rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/.*$', '') || CASE WHEN page_id % 2 = 0 THEN ' shop' ELSE '' END AS v FROM pages),
f AS (SELECT *, regexp_extract(v, '{X.DOMAIN}', 1) AS found FROM p), g AS (SELECT *, regexp_replace(regexp_replace(lower(found), '^www\.', ''), '\.[^.]*$', '') AS stub, trim(substr(v, 1, strpos(v, found) - 1) || ' ' || substr(v, strpos(v, found) + length(found))) AS rest FROM f)
SELECT page_id, CASE WHEN found = '' THEN v WHEN rest = '' THEN stub ELSE rest END AS name, CASE WHEN found = '' THEN '' ELSE stub END AS domain, CASE WHEN found = '' OR rest <> '' THEN '' ELSE stub END AS from_domain FROM g""",
)
oracle("expand_abbrev", R, f", w AS (SELECT entity_id, {Q.words('lower(name)')} AS a, {Q.words('lower(address)')} AS b FROM records) SELECT entity_id, {Q.joined(Q._expand('a', X.SEED_NAMES))} AS name_x, {Q.joined(Q._expand('b', X.SEED_ADDRESSES))} AS address_x FROM w")
_keep = f"coalesce(list_max(list_transform(w, lambda x, i: CASE WHEN x IN ({Q.listed(X.LEGAL_WORDS)}) THEN 0 ELSE i END)), 0)"
oracle("legal_split", R, f", r AS (SELECT entity_id, list_concat({Q.words('lower(name)')}, CASE WHEN doc_id % 2 = 0 THEN ['private', 'limited'] ELSE ['sa'] END) AS w FROM records) SELECT entity_id, {Q.joined(f'w[1:{_keep}]')} AS core, {Q.joined(f'list_sort(list_distinct(w[{_keep} + 1:]))')} AS suffix FROM r")
oracle("acronym_sorted", R, f", r AS (SELECT entity_id, {Q.words('lower(name)')} AS w FROM records) SELECT entity_id, coalesce(array_to_string([substr(x, 1, 1) for x in w if x NOT IN ({Q.listed(X.STOP_INITIALS)})], ''), '') AS acronym, {Q.joined('list_sort(w)')} AS name_sorted FROM r")
_ADDRESS = (
    R
    + """, a AS (SELECT entity_id, CASE doc_id % 5 WHEN 0 THEN 'h.no 12/b ' WHEN 1 THEN '105 ' WHEN 2 THEN 'plot no 7-c, ' ELSE '' END || lower(address) ||
CASE doc_id % 5 WHEN 0 THEN ', near the mill, pune 400 001' WHEN 1 THEN ' opp. city hall, TX 75001' WHEN 2 THEN ', in front of station, 560001, 12345' ELSE '' END AS v FROM records)"""
)
oracle("landmarks", _ADDRESS, rf"SELECT entity_id, regexp_replace(trim(regexp_replace(regexp_replace(v, '{X.LANDMARK}', ' ', 'g'), '\s+', ' ', 'g')), '^[ ,]+|[ ,]+$', '', 'g') AS rest, coalesce(array_to_string(list_transform(regexp_extract_all(v, '{X.LANDMARK}', 1), lambda x: trim(x)), ' | '), '') AS found FROM a")
_once = lambda c: rf"regexp_replace({c}, '(^|\D)\d{{5,6}}(\D|$)', '\1 \2', 'g')"
oracle(
    "postal", _ADDRESS,
    rf""", b AS (SELECT *, regexp_extract_all(v, '(?:^|\D)(\d{{3}}\s+\d{{3}})(?:\D|$)', 1) AS spaced, list_filter(regexp_extract_all(v, '\d+'), lambda d: length(d) BETWEEN 5 AND 6) AS plain FROM a),
c AS (SELECT *, CASE WHEN len(spaced) > 0 THEN replace(spaced[-1], ' ', '') WHEN len(plain) > 0 THEN plain[-1] ELSE '' END AS code FROM b)
SELECT entity_id, code, substr(code, 1, 3) AS prefix, CASE WHEN len(spaced) > 0 THEN replace(v, spaced[-1], ' ') WHEN len(plain) > 0 THEN {_once(_once("v"))} ELSE v END AS rest FROM c""",
)
oracle(
    "house_number", _ADDRESS,
    rf""", b AS (SELECT *, regexp_matches(v, '{X.HOUSE_LABEL}') AS l FROM a) SELECT entity_id, upper(replace(CASE WHEN l THEN regexp_extract(v, '{X.HOUSE_LABEL}', 1) ELSE regexp_extract(v, '{Q.LEADING}', 1) END, ' ', '')) AS house,
CASE WHEN l THEN regexp_replace(v, '{X.HOUSE_LABEL}', ' ') ELSE regexp_replace(v, '^\s*[\dA-Za-z][\dA-Za-z/\-]*\s+([A-Za-z])', '\1') END AS rest,
upper(replace(CASE WHEN l THEN regexp_extract(v, '{X.HOUSE_LABEL}', 1) ELSE regexp_extract(v, '^\s*(\d[\dA-Za-z/\-]*)\s+[A-Za-z]', 1) END, ' ', '')) AS strict_house FROM b""",
)
oracle("locality_street", N, "SELECT entity_id, locality_tokens, state_code, street_tokens, all_numbers FROM norm")
oracle("normalized_records", N, "SELECT * FROM norm")
oracle("normalized_by_country", N, "SELECT country, count(*) AS n, sum(address_missing)::BIGINT AS no_address, sum(postal_missing)::BIGINT AS no_postal, sum(name_had_repeat)::BIGINT AS repeats, count(DISTINCT core_name) AS names FROM norm GROUP BY 1")
_skeleton = r"regexp_replace(w, 'm([^aeiouym])', 'n\1', 'g')"
for _a, _b in X.PHONETIC:
    _skeleton = f"replace({_skeleton}, '{_a}', '{_b}')"
oracle(
    "phonetic_key", R,
    rf""", r AS (SELECT entity_id, [{_skeleton} for w in {Q.words("regexp_replace(lower(name), '[^a-z ]', '', 'g')")}] AS ws FROM records),
s AS (SELECT entity_id, [substr(w, 1, 1) || regexp_replace(substr(w, 2), '[aeiouy]', '', 'g') for w in ws] AS ws FROM r),
u AS (SELECT entity_id, [array_to_string(list_filter(string_split(w, ''), lambda c, i: i = 1 OR c <> substr(w, i - 1, 1)), '') for w in ws if w <> ''] AS ws FROM s)
SELECT entity_id, {Q.joined(f"[w for w in ws if w <> '' AND w NOT IN ({Q.listed(X.PHONETIC_LEGAL)})]")} AS phon FROM u""",
)
oracle("trigram_sets", R, f", g AS (SELECT entity_id, list_sort({Q.trigrams('name')}) AS grams FROM records) SELECT entity_id, CAST(len(grams) AS INT) AS n, grams FROM g")
oracle("record_texts", N, "SELECT entity_id, regexp_replace(CASE WHEN core_name <> '' THEN core_name ELSE name END || ' | ' || address_expanded, '^[ |]+|[ |]+$', '', 'g') AS dense_text, CASE WHEN name_script <> 'latin' THEN name || ' (' || core_name || ')' ELSE core_name END || ' | ' || address_expanded AS pair_text FROM norm")

# corpus statistics and mining
_IDF = f", tok AS (SELECT country, entity_id, unnest(list_distinct({Q.words('core_name')})) AS token FROM norm), nn AS (SELECT country, count(*) AS n FROM norm GROUP BY 1), idf AS (SELECT country, token, ln(1 + any_value(n) / count(*)) AS idf FROM tok JOIN nn USING (country) GROUP BY 1, 2)"
oracle("token_idf", N + _IDF, "SELECT * FROM idf")
oracle("name_freq", N, "SELECT country, core_name AS name, count(*) AS freq FROM norm GROUP BY 1, 2")
_sub = "length(short) < length(long) AND (starts_with(long, short) OR list_reduce(list_concat([long], string_split(short, '')), lambda acc, c: CASE WHEN acc IS NULL OR strpos(acc, c) = 0 THEN NULL ELSE substr(acc, strpos(acc, c) + 1) END) IS NOT NULL)"
_MINED = (
    R
    + f""", w AS (SELECT entity_id, {Q.words("lower(name || ' ' || address)")} AS w FROM records), b AS (SELECT a.w AS x, c.w AS y FROM pairs p JOIN w a ON a.entity_id = p.s1_id JOIN w c ON c.entity_id = p.cand_id),
e AS (SELECT unnest(x) AS short, y AS ls FROM b UNION ALL SELECT unnest(y), x FROM b), f AS (SELECT short, unnest(ls) AS long FROM e WHERE length(short) BETWEEN 2 AND 5), mined AS (SELECT short, long, count(*) AS n FROM f WHERE {_sub} GROUP BY 1, 2)"""
)
_accept = lambda t, k, d, by="": f"SELECT {by}short, long FROM (SELECT *, sum(n) OVER (PARTITION BY {by}short) AS total, row_number() OVER (PARTITION BY {by}short ORDER BY n DESC, long) AS r FROM {t}) WHERE r = 1 AND total >= {k} AND n / total >= {d}"
_SLOTS = f""", sw AS (SELECT country, {Q.words("lower(name)")} AS t FROM records), sl AS (SELECT country, 'first' AS slot, t[1] AS w FROM sw WHERE len(t) > 0 UNION ALL SELECT country, 'last', t[-1] FROM sw WHERE len(t) > 0),
sc AS (SELECT country, slot, w, count(*) AS c FROM sl GROUP BY ALL HAVING count(*) >= 3), sp AS (SELECT a.country, a.w AS short, b.w AS long FROM sc a JOIN sc b USING (country, slot) WHERE length(a.w) BETWEEN 2 AND 5 AND length(b.w) > 5),
slots AS (SELECT country, short, long, count(*) AS n FROM sp WHERE {_sub} GROUP BY ALL)"""
oracle("abbrev_pairs", _MINED, "SELECT * FROM mined")
oracle("abbrev_accept", _MINED, _accept("mined", 2, 0.5))
oracle("abbrev_unsup", R + _SLOTS, _accept("slots", 1, 0.34, "country, "))
oracle(
    "abbrev_merge", _MINED + _SLOTS,
    f""", l1(short, long) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in X.SEED_NAMES.items())}), s2 AS (SELECT short, long, sum(n) AS n FROM slots GROUP BY 1, 2), l2 AS ({_accept("s2", 1, 0.34)}), l3 AS ({_accept("mined", 2, 0.5)}),
m AS (SELECT short, coalesce(l1.long, l2.long) AS long FROM l1 FULL JOIN l2 USING (short) WHERE l1.long IS NULL OR l2.long IS NULL OR l1.long = l2.long)
SELECT short, coalesce(m.long, l3.long) AS long FROM m FULL JOIN l3 USING (short) WHERE m.long IS NULL OR l3.long IS NULL OR m.long = l3.long""",
)

# splits
_even = lambda x: f"CAST(round_even({x}, 0) AS INT)"
_STRATA = (
    R
    + f""", mc AS (SELECT s1_id AS entity_id, e.country, CAST(len(ids) AS INT) AS match_count, CASE WHEN len(ids) = 0 THEN '0-0' WHEN len(ids) = 1 THEN '1-1' WHEN len(ids) <= 3 THEN '2-3' WHEN len(ids) <= 5 THEN '4-5' ELSE '6-99' END AS bucket FROM truth JOIN entities e USING (s1_id)),
st AS (SELECT *, row_number() OVER (PARTITION BY country, bucket ORDER BY md5(entity_id || '|42'), entity_id) AS r, count(*) OVER (PARTITION BY country, bucket) AS n FROM mc),
sz AS (SELECT *, {_even("n * 0.15")} AS nr, {_even("n * 0.25")} AS ng, {_even("n * 0.10")} AS nv FROM st),
split AS (SELECT entity_id, country, match_count, CASE WHEN r <= nr THEN 'R' WHEN r <= nr + ng THEN 'G' WHEN r <= nr + ng + nv THEN 'V' ELSE 'unused' END AS "group", CASE WHEN r > nr AND r <= nr + ng AND r > nr + {_even("ng * 0.5")} THEN 'unused' END AS dropped FROM sz)"""
)
oracle("stratified_split", _STRATA, 'SELECT entity_id, country, match_count, "group" FROM split')
oracle("split_subsample", _STRATA, 'SELECT coalesce(dropped, "group") AS "group", count(*) AS n FROM split GROUP BY 1')
oracle("split_members", _STRATA, """SELECT entity_id FROM split WHERE "group" = 'V' AND country = 'en'""")
oracle("entity_holdout", C, ", i AS (SELECT DISTINCT s1_id, md5(s1_id || '|42') AS o FROM scored), k AS (SELECT greatest(1, round_even(count(*) * 0.1, 0)) AS k FROM i), h AS (SELECT s1_id, row_number() OVER (ORDER BY o) <= (SELECT k FROM k) AS held FROM i) SELECT s1_id, cand_id, CAST(held AS INT) AS held FROM scored JOIN h USING (s1_id)")
oracle("split_halves", R, ", o AS (SELECT s1_id, CAST('0x' || substr(md5(s1_id || '|42'), 1, 8) AS BIGINT) / 4294967296.0 AS o FROM entities) SELECT s1_id, CASE WHEN o < 0.5 THEN 'a' ELSE 'b' END AS half, CAST(o < 0.05 AS INT) AS early FROM o")

# blocking
_LOC = f"CASE WHEN len({Q.words('core_name')}) = 0 THEN [] ELSE [list_reduce({Q.words('core_name')}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) || '||' || p for p in list_distinct(list_concat({Q.words('locality_tokens')}, [x for x in [postal_code] if x <> '']))] END"
_HOUSE = f"CASE WHEN house_number = '' THEN [] ELSE [house_number || '||' || s for s in {Q.words('street_tokens')}] END"
_ACR = f"CASE WHEN length(acronym) < 2 THEN [] ELSE [acronym || '||' || p for p in list_concat([x for x in [postal_prefix3] if x <> ''], {Q.words('locality_tokens')})] END"


def _arm(name: str, keys: str, cap: int, table: str = "norm") -> str:
    return f""", {name}_p AS (SELECT country, 'S' || source AS cand_source, entity_id AS cand_id, unnest({keys}) AS k FROM {table} WHERE source > 1), {name}_s AS (SELECT country, cand_source, k FROM {name}_p GROUP BY ALL HAVING count(*) <= {cap}),
{name}_q AS (SELECT country, entity_id AS s1_id, unnest({keys}) AS k FROM {table} WHERE source = 1),
{name} AS (SELECT DISTINCT q.s1_id, p.cand_id, p.cand_source FROM {name}_q q JOIN {name}_p p USING (country, k) JOIN {name}_s s ON s.country = p.country AND s.cand_source = p.cand_source AND s.k = p.k)"""


oracle("key_arm_locality", N + _arm("loc_arm", _LOC, 200), "SELECT * FROM loc_arm")
oracle("key_arm_house", N + _arm("house_arm", _HOUSE, 200), "SELECT * FROM house_arm")
oracle("key_arm_acronym", N + _arm("acr_arm", _ACR, 100), "SELECT * FROM acr_arm")
oracle("capped_key_join", C, "SELECT s1_id, cand_id, cand_source FROM cand")


def _chars(c: str) -> str:
    w = f"[' ' || w || ' ' for w in {Q.words(f'lower({c})')}]"
    three = "list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))"
    four = "CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) ELSE [] END"
    return f"flatten([list_concat({three}, {four}) for w in {w}])"


def _wordgrams(c: str) -> str:
    w = rf"[w for w in regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}_]+') if length(w) >= 2]"
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def _tfidf(name: str, terms: str, max_df: float, k: int) -> str:
    return f""", {name}_c AS (SELECT country, entity_id, source, term, count(*) AS tf FROM (SELECT country, entity_id, source, unnest({terms}) AS term FROM norm) GROUP BY ALL), {name}_n AS (SELECT country, count(*) AS n FROM norm GROUP BY 1),
{name}_d AS (SELECT country, term, count(*) AS df, any_value(n) AS n FROM {name}_c JOIN {name}_n USING (country) GROUP BY 1, 2), {name}_k AS (SELECT country, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM {name}_d WHERE df >= 2 AND df <= greatest(n * {max_df}, 2.0)),
{name}_w AS (SELECT country, entity_id, source, term, (1 + ln(tf)) * idf AS w FROM {name}_c JOIN {name}_k USING (country, term)), {name}_v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS u FROM {name}_w),
{name}_x AS (SELECT q.entity_id AS s1_id, p.entity_id AS cand_id, 'S' || p.source AS cand_source, sum(q.u * p.u) AS score FROM {name}_v q JOIN {name}_v p USING (country, term) WHERE q.source = 1 AND p.source > 1 GROUP BY 1, 2, 3 HAVING round(sum(q.u * p.u), 9) > 0.2),
{name} AS (SELECT s1_id, cand_id, cand_source, score, CAST(row_number() OVER (PARTITION BY s1_id, cand_source ORDER BY round(score, 9) DESC, cand_id) - 1 AS INT) AS rank FROM {name}_x QUALIFY rank < {k})"""


_NAME, _ADDR = _tfidf("name_arm", _chars("core_name"), 0.1, 10), _tfidf("addr_arm", _wordgrams("address_expanded"), 0.1, 10)
oracle("tfidf_name_topk", N + _NAME, "SELECT s1_id, cand_id, cand_source, round(score, 6) AS score, rank FROM name_arm")
oracle("tfidf_addr_topk", N + _ADDR, "SELECT s1_id, cand_id, cand_source, round(score, 6) AS score, rank FROM addr_arm")
oracle(
    "dense_knn_exact", "",
    """WITH s AS (SELECT q.vec_id AS s1_id, p.vec_id AS cand_id, list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings p ON q.label = p.label WHERE q.vec_id % 3 = 0 AND p.vec_id % 3 <> 0)
SELECT s1_id, cand_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, cand_id) - 1 AS INT) AS rank FROM s QUALIFY rank < 15""",
)
oracle(
    "candidate_union", N + _NAME + _ADDR + _arm("loc_arm", _LOC, 200) + _arm("house_arm", _HOUSE, 200) + _arm("acr_arm", _ACR, 100),
    """, u AS (SELECT s1_id, cand_id, cand_source, score AS ns, rank AS nr, NULL AS ads, NULL AS ar, 0 AS kl, 0 AS kh, 0 AS ka FROM name_arm UNION ALL SELECT s1_id, cand_id, cand_source, NULL, NULL, score, rank, 0, 0, 0 FROM addr_arm
UNION ALL SELECT s1_id, cand_id, cand_source, NULL, NULL, NULL, NULL, 1, 0, 0 FROM loc_arm UNION ALL SELECT s1_id, cand_id, cand_source, NULL, NULL, NULL, NULL, 0, 1, 0 FROM house_arm UNION ALL SELECT s1_id, cand_id, cand_source, NULL, NULL, NULL, NULL, 0, 0, 1 FROM acr_arm),
m AS (SELECT s1_id, cand_id, cand_source, max(ns) AS ns, min(nr) AS nr, max(ads) AS ads, min(ar) AS ar, max(kl) AS kl, max(kh) AS kh, max(ka) AS ka FROM u GROUP BY 1, 2, 3),
h AS (SELECT *, CAST(ns IS NOT NULL AS INT) + CAST(ads IS NOT NULL AS INT) + kl + kh + ka AS n_arms_hit FROM m)
SELECT s1_id, cand_id, cand_source, CAST(NULL AS DOUBLE) AS dense_score, round(ns, 6) AS name_tfidf_score, round(ads, 6) AS addr_tfidf_score, kl AS key_locrare_hit, kh AS key_house_hit, ka AS key_acr_hit, CAST(NULL AS INT) AS dense_rank, nr AS name_tfidf_rank, ar AS addr_tfidf_rank, n_arms_hit
FROM h QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY n_arms_hit DESC, round(greatest(coalesce(ns, 0), coalesce(ads, 0)), 9) DESC, cand_id) <= 40""",
)
oracle("blocking_recall", C, "SELECT e.country, count(*) AS true_pairs, count(c.cand_id) AS found, count(c.cand_id) / count(*) AS recall FROM pairs p JOIN entities e USING (s1_id) LEFT JOIN cand c ON c.s1_id = p.s1_id AND c.cand_id = p.cand_id GROUP BY 1")

# similarities
_ASCII = ", az AS (SELECT s1_id, cand_id, regexp_replace(s_name, '[^\\x00-\\x7F]', '', 'g') AS a, regexp_replace(c_name, '[^\\x00-\\x7F]', '', 'g') AS b FROM scored)"
oracle("jaro_winkler", C + _ASCII, "SELECT s1_id, cand_id, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE round(jaro_winkler_similarity(a, b), 6) END AS jw FROM az")
oracle("levenshtein_sim", C + _ASCII, "SELECT s1_id, cand_id, CASE WHEN a = '' AND b = '' THEN 1.0 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) END AS lev FROM az")
oracle("trigram_jaccard", C, f"SELECT s1_id, cand_id, round({Q.jaccard(Q.trigrams('s_name'), Q.trigrams('c_name'), '1.0')}, 6) AS char3 FROM scored")
oracle("token_jaccard", C, f"SELECT s1_id, cand_id, round(jn, 6) AS stage_b, round({Q.jaccard(Q.words('s_addr'), Q.words('c_addr'), '1.0')}, 6) AS stage_a FROM scored")
oracle(
    "idf_jaccard", C,
    f""", t AS (SELECT country, entity_id, unnest(wn) AS token FROM rw), nn AS (SELECT country, count(*) AS n FROM rw GROUP BY 1), idf AS (SELECT country, token, ln(1 + any_value(n) / count(*)) AS idf FROM t JOIN nn USING (country) GROUP BY 1, 2),
x AS (SELECT c.s1_id, c.cand_id, a.country, unnest(list_distinct(list_concat(a.wn, b.wn))) AS token, a.wn AS aw, b.wn AS bw FROM cand c JOIN rw a ON a.entity_id = c.s1_id JOIN rw b ON b.entity_id = c.cand_id)
SELECT s1_id, cand_id, round(coalesce(sum(idf) FILTER (list_contains(aw, token) AND list_contains(bw, token)), 0) / greatest(sum(idf), 1e-9), 6) AS idf_jac FROM x JOIN idf USING (country, token) GROUP BY 1, 2""",
)
_BOTH = N + C[len(R) :] + ", np AS (SELECT c.s1_id, c.cand_id, c.cand_source, a AS s, b AS c FROM cand c JOIN norm a ON a.entity_id = c.s1_id JOIN norm b ON b.entity_id = c.cand_id)"
_ini = lambda c: f"coalesce(array_to_string([substr(w, 1, 1) for w in {Q.words(c)}], ''), '')"
_shared = lambda n: f"CAST(len(list_intersect(list_distinct({Q.words('s.' + n)}), list_distinct({Q.words('c.' + n)}))) AS INT)"
oracle(
    "pair_flags", _BOTH,
    f"""SELECT s1_id, cand_id, {Q.eq("s.core_name", "c.core_name")} AS core_eq, {Q.eq("s.name_sorted", "c.name_sorted")} AS sorted_eq, {Q.eq("s.house_number", "c.house_number")} AS house_eq, {Q.eq("s.postal_code", "c.postal_code")} AS postal_eq,
CAST((s.acronym <> '' AND (s.acronym = c.acronym OR s.acronym = {_ini("c.core_name")})) OR (c.acronym <> '' AND c.acronym = {_ini("s.core_name")}) AS INT) AS acronym,
CASE WHEN s.legal_suffix = '' AND c.legal_suffix = '' THEN 0 WHEN s.legal_suffix = c.legal_suffix THEN 1 WHEN s.legal_suffix = '' OR c.legal_suffix = '' THEN 2 ELSE 3 END AS legal, {_shared("all_numbers")} AS nums_shared, {_shared("landmark_text")} AS landmarks_shared FROM np""",
)
oracle("pair_cosine", "", "SELECT a.vec_id, round(coalesce(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), -2.0), 5) AS cos FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 7")

# features
_match = lambda x: f"(CASE WHEN {x}.core_name <> '' THEN {x}.core_name ELSE {x}.name_roman END)"
_set = lambda n: Q.jaccard(Q.words("s." + n), Q.words("c." + n), "1.0")
oracle(
    "stage_a_set_features", _BOTH,
    f"""SELECT s1_id, cand_id, round({Q.jaccard(Q.trigrams(_match("s")), Q.trigrams(_match("c")), "1.0")}, 6) AS f_name_char3, round({_set("all_numbers")}, 6) AS f_nums_jac, round({_set("locality_tokens")}, 6) AS f_loc_overlap,
{Q.eq("s.house_number", "c.house_number")} AS f_house_eq, {Q.eq("s.postal_code", "c.postal_code")} AS f_postal_eq FROM np""",
)
oracle(
    "listwise_s1", C,
    """, r AS (SELECT s1_id, cand_id, cand_source, p_match AS p, round(jn, 6) AS a FROM scored), x AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS rp, row_number() OVER (PARTITION BY s1_id ORDER BY a DESC, cand_id) AS ra FROM r),
y AS (SELECT *, max(p) OVER w AS mx, coalesce(max(p) FILTER (rp = 2) OVER w, max(p) OVER w) AS second, avg(p) OVER w AS mean, count(*) FILTER (p > 0.5) OVER w AS n5, max(a) OVER w AS ma, max(p) OVER v AS sm, avg(p) OVER v AS sa FROM x WINDOW w AS (PARTITION BY s1_id), v AS (PARTITION BY s1_id, cand_source))
SELECT s1_id, cand_id, rp AS f_rank_by_rerank, mx AS f_rerank_max, round(mean, 6) AS f_rerank_mean, second AS f_rerank_2nd, round(mx - p, 6) AS f_rerank_gap_best, round(mx - second, 6) AS f_rerank_best_2nd_gap, n5 AS f_rerank_above_05, ra AS f_rank_by_stagea, ma AS f_stagea_max,
CASE WHEN cand_source = 'S2' THEN sm ELSE -1.0 END AS "f_rerank_max_S2", round(CASE WHEN cand_source = 'S2' THEN sa ELSE -1.0 END, 6) AS "f_rerank_mean_S2", CASE WHEN cand_source = 'S3' THEN sm ELSE -1.0 END AS "f_rerank_max_S3", round(CASE WHEN cand_source = 'S3' THEN sa ELSE -1.0 END, 6) AS "f_rerank_mean_S3" FROM y""",
)
oracle("listwise_candidate", C, "SELECT s1_id, cand_id, count(*) OVER w AS f_cand_competitors, max(p_match) OVER w AS f_cand_best_rerank_for_others, round(max(p_match) OVER w - p_match, 6) AS f_cand_gap_to_best, row_number() OVER (PARTITION BY cand_id ORDER BY p_match DESC, s1_id) AS f_cand_rank_among_competitors FROM scored WINDOW w AS (PARTITION BY cand_id)")
oracle("support_feature", C, "SELECT s1_id, cand_id, coalesce(CASE WHEN cand_source = 'S2' THEN max(p_match) FILTER (cand_source = 'S3') OVER w ELSE max(p_match) FILTER (cand_source = 'S2') OVER w END, -1.0) AS f_support FROM scored WINDOW w AS (PARTITION BY s1_id)")
oracle(
    "context_features", C,
    """, x AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p_match DESC, cand_id) AS r FROM scored), y AS (SELECT *, max(p_match) OVER w AS mx, coalesce(max(p_match) FILTER (r = 2) OVER w, 0.0) AS second, max(p_match) OVER v AS cm FROM x WINDOW w AS (PARTITION BY s1_id), v AS (PARTITION BY cand_id))
SELECT s1_id, cand_id, p_match AS c_p, mx AS c_s1_max, round(mx - p_match, 6) AS c_s1_gap, r AS c_s1_rank, round(sum(p_match) OVER w, 6) AS c_s1_sum, count(*) FILTER (p_match > 0.5) OVER w AS c_s1_n50, count(*) FILTER (p_match > 0.8) OVER w AS c_s1_n80, second AS c_s1_2nd, round(mx - second, 6) AS c_s1_gap12,
coalesce(CASE WHEN cand_source = 'S2' THEN max(p_match) FILTER (cand_source = 'S3') OVER w ELSE max(p_match) FILTER (cand_source = 'S2') OVER w END, -1.0) AS c_other_src_max, cm AS c_cand_max, round(cm - p_match, 6) AS c_cand_gap, count(*) OVER v AS c_cand_n, row_number() OVER (PARTITION BY cand_id ORDER BY p_match DESC, s1_id) AS c_cand_rank
FROM y WINDOW w AS (PARTITION BY s1_id), v AS (PARTITION BY cand_id)""",
)
oracle(
    "anchor_pairs", C,
    """, x AS (SELECT s1_id, cand_id, cand_source, p_match, row_number() OVER (PARTITION BY s1_id ORDER BY p_match DESC, cand_id) AS r FROM scored)
SELECT a.s1_id, a.cand_id, b.cand_id AS an_id, b.cand_source AS an_source, b.p_match AS an_p, CAST(a.r = 1 AS INT) AS an_is_top FROM x a LEFT JOIN x b ON b.s1_id = a.s1_id AND b.r = CASE WHEN a.r = 1 THEN 2 ELSE 1 END""",
)
oracle("top_candidates", C, "SELECT s1_id, cand_id, p_match AS stage_a_score FROM scored QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p_match DESC, cand_id) <= 3")
_TOP = ", top AS (SELECT s1_id, cand_id, p_match FROM scored QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p_match DESC, cand_id) <= 3)"
oracle("candidate_lists", C, _TOP + " SELECT e.s1_id AS source1_entity_id, coalesce(string_agg(t.cand_id, ',' ORDER BY t.p_match DESC, t.cand_id), '') AS candidate_entity_ids FROM entities e LEFT JOIN top t USING (s1_id) GROUP BY 1")
oracle("prefilter_recall", C, _TOP + ", m AS (SELECT b.cand_id AS b, t.cand_id AS k FROM (SELECT DISTINCT s1_id, cand_id FROM pairs) p LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM cand) b ON b.s1_id = p.s1_id AND b.cand_id = p.cand_id LEFT JOIN top t ON t.s1_id = p.s1_id AND t.cand_id = p.cand_id) SELECT count(*) AS true_pairs, count(b) / greatest(count(*), 1) AS blocking_recall, count(k) / greatest(count(*), 1) AS prefilter_recall, (count(b) - count(k)) / greatest(count(*), 1) AS loss FROM m")
oracle("hard_negatives", C, ", l AS (SELECT s.s1_id, s.cand_id, s.p_match, CAST(p.cand_id IS NOT NULL AS INT) AS y FROM scored s LEFT JOIN pairs p ON p.s1_id = s.s1_id AND p.cand_id = s.cand_id), r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY y, p_match DESC, cand_id) AS r, greatest(1, sum(y) OVER (PARTITION BY s1_id)) AS k FROM l) SELECT s1_id, cand_id, y FROM r WHERE y = 1 OR r <= 2 * k")

# decision and evaluation
oracle("one_to_one", C, "SELECT s1_id, cand_id, p_match FROM scored QUALIFY row_number() OVER (PARTITION BY country, cand_id ORDER BY p_match DESC, s1_id) = 1")
oracle("decide_full", D, "SELECT s1_id, cand_id, p_match FROM decided")


def _decide(source: str, pair: str, single: str, by: str = "") -> str:
    return f""", k1 AS (SELECT * FROM {source} WHERE p_match >= {pair} QUALIFY row_number() OVER (PARTITION BY {by}cand_id ORDER BY p_match DESC, s1_id) = 1), k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p_match DESC, cand_id) <= 12)
SELECT s1_id, cand_id, p_match FROM k2 QUALIFY max(p_match) OVER (PARTITION BY s1_id) >= {single}"""


oracle("decide_margin", C, ", m AS (SELECT * FROM scored WHERE p_match >= 0.2 QUALIFY max(p_match) OVER (PARTITION BY cand_id) - p_match <= 0.1)" + _decide("m", "0.2", "0.3"))
oracle("per_partition_thresholds", C, ", t(country, tp, ts) AS (VALUES ('en', 0.4, 0.6), ('fr', 0.55, 0.55)), m AS (SELECT s.*, coalesce(tp, 0.5) AS tp, coalesce(ts, 0.7) AS ts FROM scored s LEFT JOIN t USING (country))" + _decide("m", "tp", "ts", "country, "))
_F = "CASE WHEN len(predicted) = 0 AND len(ids) = 0 THEN 1.0 WHEN len(list_intersect(predicted, ids)) = 0 THEN 0.0 ELSE 1.25 * len(list_intersect(predicted, ids)) / (len(predicted) + 0.25 * len(ids)) END"
_SCORES = D + f", pl AS (SELECT s1_id, list(cand_id) AS pl FROM decided GROUP BY 1), es AS (SELECT s1_id, ids, coalesce(pl, []) AS predicted FROM truth LEFT JOIN pl USING (s1_id)), ef AS (SELECT *, {_F} AS f FROM es)"
oracle("entity_fbeta", _SCORES, "SELECT s1_id, round(f, 6) AS f FROM ef")
oracle("macro_fbeta", _SCORES, "SELECT count(*) AS entities, round(avg(f), 6) AS f, round(avg(f) FILTER (len(ids) = 0), 6) AS f_singletons, round(avg(f) FILTER (len(ids) > 0), 6) AS f_others, count(*) FILTER (len(predicted) = 0) AS predicted_empty, round(avg(CASE WHEN len(predicted) = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_rate, round(avg(len(predicted)), 6) AS mean_matches FROM ef")
oracle(
    "threshold_grid", C,
    """, v AS (SELECT round(0.30 + 0.05 * i, 2) AS v, i FROM range(13) r(i)), g AS (SELECT CAST(row_number() OVER (ORDER BY a.i, b.i) - 1 AS INT) AS g, CAST(a.v AS DOUBLE) AS pair, CAST(b.v AS DOUBLE) AS singleton FROM v a JOIN v b ON a.i <= b.i),
k1 AS (SELECT g.*, s.* FROM g JOIN scored s ON s.p_match >= g.pair QUALIFY row_number() OVER (PARTITION BY g.g, cand_id ORDER BY p_match DESC, s1_id) = 1), k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY g, s1_id ORDER BY p_match DESC, cand_id) <= 12),
k3 AS (SELECT * FROM k2 QUALIFY max(p_match) OVER (PARTITION BY g, s1_id) >= singleton), n AS (SELECT g, k3.s1_id, count(*) AS n, count(p.cand_id) AS tp FROM k3 LEFT JOIN pairs p ON p.s1_id = k3.s1_id AND p.cand_id = k3.cand_id GROUP BY 1, 2)
SELECT CAST(f.g * 3 + m.i AS INT) AS g, pair, singleton, CAST(m.margin AS DOUBLE) AS margin, f FROM (SELECT g.g, g.pair, g.singleton, round(avg(CASE WHEN coalesce(n, 0) = 0 AND len(ids) = 0 THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 1.25 * tp / (n + 0.25 * len(ids)) END), 6) AS f FROM g CROSS JOIN truth t LEFT JOIN n ON n.g = g.g AND n.s1_id = t.s1_id GROUP BY 1, 2, 3) f CROSS JOIN (VALUES (0, NULL), (1, 0.05), (2, 0.10)) m(i, margin)""",
)
oracle("unlabelled_diagnostic", D, ", c AS (SELECT e.s1_id, count(d.cand_id) AS n FROM entities e LEFT JOIN decided d USING (s1_id) GROUP BY 1) SELECT round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS singleton_rate, round(avg(n), 6) AS mean_matches, 0.0558::DOUBLE AS expected_rate, 3.461::DOUBLE AS expected_matches FROM c")
oracle(
    "validate_output", D,
    """, b AS (SELECT e.s1_id AS id, CAST(right(e.s1_id, 2) AS INT) % 10 AS k, coalesce(list(d.cand_id) FILTER (d.cand_id IS NOT NULL), []) AS l FROM entities e LEFT JOIN decided d USING (s1_id) GROUP BY 1, 2),
x AS (SELECT id, k, list_concat(l, CASE k WHEN 1 THEN [id] WHEN 2 THEN ['S2-1', 'S2-1'] WHEN 3 THEN ['X9'] ELSE [] END) AS l FROM b),
o AS (SELECT id, l FROM x WHERE k <> 4 UNION ALL SELECT id, l FROM x WHERE k = 5 UNION ALL SELECT 'S1-x' || id, l FROM x WHERE k = 6),
i AS (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(l) AS c FROM o) GROUP BY 1, 2)
SELECT 'duplicate_row' AS rule, id AS source1_entity_id, CAST(count(*) AS VARCHAR) AS detail FROM o GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'repeated_id', id, c FROM i WHERE n > 1 UNION ALL SELECT 'self_match', id, c FROM i WHERE c = id
UNION ALL SELECT 'bad_prefix', id, c FROM i WHERE NOT (starts_with(c, 'S2-') OR starts_with(c, 'S3-')) UNION ALL SELECT 'missing_entity', s1_id, '' FROM entities WHERE s1_id NOT IN (SELECT id FROM o)
UNION ALL SELECT DISTINCT 'extra_entity', id, '' FROM o WHERE id NOT IN (SELECT s1_id FROM entities) UNION ALL SELECT 'unknown_id', id, c FROM i WHERE c NOT IN (SELECT entity_id FROM records)""",
)
oracle("missed_rate", C, ", m AS (SELECT p.s1_id, count(*) AS m FROM pairs p LEFT JOIN cand c ON c.s1_id = p.s1_id AND c.cand_id = p.cand_id WHERE c.cand_id IS NULL GROUP BY 1) SELECT country, round(coalesce(sum(m), 0) / count(*), 6)::DOUBLE AS missed FROM entities LEFT JOIN m USING (s1_id) GROUP BY 1")
oracle(
    "abbrev_dictionary", _MINED + _SLOTS,
    f""", l1(short, long) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in X.SEED_NAMES.items())}), a2 AS (SELECT DISTINCT short, long FROM ({_accept("slots", 1, 0.5, "country, ")})), l2 AS (SELECT short, min(long) AS long FROM a2 GROUP BY 1 HAVING count(*) = 1), l3 AS ({_accept("mined", 2, 0.5)}),
m AS (SELECT short, coalesce(l1.long, l2.long) AS long FROM l1 FULL JOIN l2 USING (short) WHERE l1.long IS NULL OR l2.long IS NULL OR l1.long = l2.long)
SELECT short, coalesce(m.long, l3.long) AS long FROM m FULL JOIN l3 USING (short) WHERE m.long IS NULL OR l3.long IS NULL OR m.long = l3.long""",
)
