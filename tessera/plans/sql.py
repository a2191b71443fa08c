"""DuckDB SQL parts that the oracles are put together from."""

from __future__ import annotations

from tessera.functions import text as X


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def mapping(m: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"


def words(c: str) -> str:
    return f"[w for w in regexp_split_to_array({c}, '\\s+') if w <> '']"


def joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, ' '), '')"


def _expand(c: str, m: dict[str, str]) -> str:
    """Keys of two words all end in one that starts none, so that looking at neighbours is the same as going from left to right."""
    one, two = {k: v for k, v in m.items() if " " not in k}, {k: v for k, v in m.items() if " " in k}
    pair = f"({mapping(two)})[w || ' ' || coalesce({c}[i + 1], '')]" if two else "NULL"
    before = f"WHEN i > 1 AND ({mapping(two)})[{c}[i - 1] || ' ' || w] IS NOT NULL THEN NULL" if two else ""
    return f"list_filter(list_transform({c}, lambda w, i: CASE WHEN {pair} IS NOT NULL THEN {pair} {before} ELSE coalesce(({mapping(one)})[w], w) END), lambda w: w IS NOT NULL)"


def _junk(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '\s*\|.*$', ''), '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')"


def clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(replace({_junk(c)}, '&', ' and '), '@', ' at '), '[^\p{{L}}\p{{N}}_\s/\-.,&@]', ' ', 'g'), '\s+', ' ', 'g'))"


def once(c: str) -> str:
    return f"list_filter({c}, lambda w, i: i = 1 OR w <> {c}[i - 1])"


def dots(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\.+', ''), '\.+$', '')"


def trigrams(c: str) -> str:
    return f"CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) ELSE [] END"


def jaccard(a: str, b: str, empty: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN {empty} ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / {union} END"


def eq(a: str, b: str) -> str:
    return f"CAST(coalesce({a} = {b} AND {a} <> '', false) AS INT)"


DOMAIN = X.DOMAIN
LEADING = r"^\s*([\dA-Za-z][\dA-Za-z/\-]*)\s+[A-Za-z]"

RECORDS = r"""
docs AS (SELECT doc_id, lang, text, [w for w in regexp_split_to_array(text, '[ \t\n\r]+') if w <> ''] AS t FROM documents),
records AS (SELECT 'S' || CAST(doc_id % 3 + 1 AS VARCHAR) || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS entity_id, CAST(doc_id % 3 + 1 AS INT) AS source,
  coalesce(array_to_string(t[1:6], ' '), '') AS name, coalesce(array_to_string(t[7:18], ' '), '') AS address, lang AS country, doc_id, text FROM docs),
pairs AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM records a JOIN records b ON a.text = b.text WHERE a.source = 1 AND b.source > 1),
entities AS (SELECT entity_id AS s1_id, country FROM records WHERE source = 1),
truth AS (SELECT e.s1_id, coalesce(list_sort(list(p.cand_id) FILTER (p.cand_id IS NOT NULL)), []) AS ids FROM entities e LEFT JOIN pairs p USING (s1_id) GROUP BY 1)"""

_state = lambda k, before: f"CASE WHEN len(us{k}) > 0 THEN us{k}[1] WHEN {before} = '' AND len(ind{k}) > 0 THEN ind{k}[1] ELSE {before} END"

NORMALISED = (
    RECORDS
    + rf""",
n1 AS (SELECT *, {words("lower(strip_accents(" + clean("name") + "))")} AS nw, {words("lower(strip_accents(" + clean("address") + "))")} AS aw FROM records),
n2 AS (SELECT *, {joined(once("nw"))} AS name_clean, {once("nw")} AS nc, {joined(once("aw"))} AS ac FROM n1),
n3 AS (SELECT *, lower(regexp_extract(name_clean, '{DOMAIN}', 1)) AS dom, length(regexp_extract(name_clean, '{DOMAIN}', 1)) AS dl,
  trim(regexp_replace(regexp_replace(regexp_replace(ac, '{X.LANDMARK}', ' ', 'g'), '\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g')) AS no_lm,
  coalesce(array_to_string(list_transform(regexp_extract_all(ac, '{X.LANDMARK}', 1), lambda x: trim(x)), ' | '), '') AS landmark_text FROM n2),
n4 AS (SELECT *, regexp_replace(regexp_replace(dom, '^www\.', ''), '\.[^.]*$', '') AS stub,
  trim(substr(name_clean, 1, strpos(name_clean, regexp_extract(name_clean, '{DOMAIN}', 1)) - 1) || ' ' || substr(name_clean, strpos(name_clean, regexp_extract(name_clean, '{DOMAIN}', 1)) + dl)) AS without_dom FROM n3),
n5 AS (SELECT *, CASE WHEN dom = '' THEN name_clean WHEN without_dom = '' THEN stub ELSE without_dom END AS name_no_dom,
  CASE WHEN dom = '' THEN '' ELSE stub END AS name_domain, CASE WHEN dom = '' OR without_dom <> '' THEN '' ELSE stub END AS name_from_domain FROM n4),
n6 AS (SELECT *, {words("name_no_dom")} AS ndw, {words("no_lm")} AS alw FROM n5),
n7 AS (SELECT *, {joined(_expand("ndw", X.SEED_NAMES))} AS name_expanded, {joined(_expand("alw", X.SEED_ADDRESSES))} AS address_expanded FROM n6),
n8 AS (SELECT *, {words("name_expanded")} AS new, coalesce(list_max(list_transform({words("name_expanded")}, lambda w, i: CASE WHEN w IN ({listed(X.LEGAL_WORDS)}) THEN 0 ELSE i END)), 0) AS keep,
  regexp_extract_all(address_expanded, '(?:^|\D)(\d{{3}}\s+\d{{3}})(?:\D|$)', 1) AS spaced, list_filter(regexp_extract_all(address_expanded, '\d+'), lambda d: length(d) BETWEEN 5 AND 6) AS plain FROM n7),
n9 AS (SELECT *, new[1:keep] AS core, new[keep + 1:] AS tail,
  CASE WHEN len(spaced) > 0 THEN replace(spaced[-1], ' ', '') WHEN len(plain) > 0 THEN plain[-1] ELSE '' END AS postal_code,
  CASE WHEN len(spaced) > 0 THEN replace(address_expanded, spaced[-1], ' ')
    WHEN len(plain) > 0 THEN regexp_replace(regexp_replace(address_expanded, '(^|\D)\d{{5,6}}(\D|$)', '\1 \2', 'g'), '(^|\D)\d{{5,6}}(\D|$)', '\1 \2', 'g') ELSE address_expanded END AS no_postal FROM n8),
n10 AS (SELECT *, upper(replace(CASE WHEN regexp_matches(no_postal, '{X.HOUSE_LABEL}') THEN regexp_extract(no_postal, '{X.HOUSE_LABEL}', 1) ELSE regexp_extract(no_postal, '{LEADING}', 1) END, ' ', '')) AS house_number,
  CASE WHEN regexp_matches(no_postal, '{X.HOUSE_LABEL}') THEN regexp_replace(no_postal, '{X.HOUSE_LABEL}', ' ') ELSE regexp_replace(no_postal, '^\s*[\dA-Za-z][\dA-Za-z/\-]*\s+([A-Za-z])', '\1') END AS no_house FROM n9),
n11 AS (SELECT *, [trim(p) for p in string_split(no_house, ',') if trim(p) <> ''] AS parts FROM n10),
n12 AS (SELECT *, CASE WHEN len(parts) > 3 THEN parts[len(parts) - 2:] ELSE parts END AS seg FROM n11),
n13 AS (SELECT *, [w for w in [{dots("lower(w)")} for w in flatten([{words("p")} for p in seg])] if regexp_full_match(w, '\p{{L}}+') AND w NOT IN ({listed(X.GENERIC_WORDS)})] AS loc,
  {", ".join(f"[w for w in [{dots('upper(w)')} for w in {words(f'coalesce(seg[{k}], ' + chr(39) * 2 + ')')}] if w IN ({listed(X.US_STATES)})] AS us{k}, [w for w in [lower(w) for w in {words(f'coalesce(seg[{k}], ' + chr(39) * 2 + ')')}] if w IN ({listed(X.INDIAN_STATES)})] AS ind{k}" for k in (1, 2, 3))} FROM n12),
n14 AS (SELECT *, {_state(1, "''")} AS st1 FROM n13), n15 AS (SELECT *, {_state(2, "st1")} AS st2 FROM n14),
norm AS (SELECT entity_id, source, name, address, country, doc_id,
  CASE WHEN regexp_matches(name, '[^\p{{P}}\p{{N}}\p{{Z}}\s]') THEN 'latin' ELSE 'empty' END AS name_script, CASE WHEN regexp_matches(address, '[^\p{{P}}\p{{N}}\p{{Z}}\s]') THEN 'latin' ELSE 'empty' END AS address_script,
  name AS name_roman, address AS address_roman, name_clean, name_expanded, {joined("core")} AS core_name, {joined("list_sort(list_distinct(tail))")} AS legal_suffix, name_domain, name_from_domain,
  coalesce(array_to_string([substr(w, 1, 1) for w in core if w NOT IN ({listed(X.STOP_INITIALS)})], ''), '') AS acronym, {joined("list_sort(core)")} AS name_sorted,
  CAST(len(nc) < len(nw) AS INT) AS name_had_repeat, CAST(name_expanded <> name_no_dom AS INT) AS expansion_changed_name, 1 AS romanization_ok, address_expanded, landmark_text, postal_code,
  substr(postal_code, 1, 3) AS postal_prefix3, house_number, {joined(f"regexp_extract_all(address_expanded, '{X.NUMBER}', 1)")} AS all_numbers, {joined("loc")} AS locality_tokens, {_state(3, "st2")} AS state_code,
  {joined(f"[w for w in [{dots('lower(w)')} for w in regexp_split_to_array(no_house, '[{chr(92)}s,]+') if w <> ''] if w <> '' AND NOT list_contains(loc, w) AND w <> lower(house_number) AND w <> postal_code AND w NOT IN ({listed(X.GENERIC_WORDS)}) AND NOT regexp_full_match(w, '{chr(92)}d+')]")} AS street_tokens,
  CAST(ac = '' AS INT) AS address_missing, CAST(postal_code = '' AS INT) AS postal_missing, CAST(house_number = '' AS INT) AS house_number_missing, CAST(len(loc) = 0 AS INT) AS locality_missing FROM n15)"""
)

#: Scored candidates that both engines can make: records of one country that share a lower-cased name word held by few of the pool.
CANDIDATES = (
    RECORDS
    + f""",
rw AS (SELECT *, list_distinct({words("lower(name)")}) AS wn, list_distinct({words("lower(address)")}) AS wa FROM records),
pool_keys AS (SELECT country, 'S' || source AS cand_source, entity_id AS cand_id, unnest(wn) AS k FROM rw WHERE source > 1),
small AS (SELECT country, cand_source, k FROM pool_keys GROUP BY ALL HAVING count(*) <= 200),
query_keys AS (SELECT country, entity_id AS s1_id, unnest(wn) AS k FROM rw WHERE source = 1),
cand AS (SELECT DISTINCT q.s1_id, p.cand_id, p.cand_source FROM query_keys q JOIN pool_keys p USING (country, k) SEMI JOIN small s ON s.country = p.country AND s.cand_source = p.cand_source AND s.k = p.k),
scored0 AS (SELECT c.*, a.country, a.name AS s_name, b.name AS c_name, a.address AS s_addr, b.address AS c_addr, {jaccard("a.wn", "b.wn", "0.0")} AS jn, {jaccard("a.wa", "b.wa", "0.0")} AS ja
  FROM cand c JOIN rw a ON a.entity_id = c.s1_id JOIN rw b ON b.entity_id = c.cand_id),
scored AS (SELECT *, round(0.4 * jn + 0.6 * ja, 6) AS p_match FROM scored0)"""
)

#: The decision on them, step by step.
DECIDED = (
    CANDIDATES
    + """,
best AS (SELECT * FROM scored WHERE p_match >= 0.5 QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p_match DESC, s1_id) = 1),
capped AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p_match DESC, cand_id) <= 12),
decided AS (SELECT s1_id, cand_id, cand_source, country, p_match FROM capped QUALIFY max(p_match) OVER (PARTITION BY s1_id) >= 0.7)"""
)
