"""Text normalisation as Column expressions. Null counts as the empty string throughout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lists and seeds that normalisation is defined by.
LEGAL_WORDS = (
    "llc", "inc", "incorporated", "corp", "corporation", "company", "co", "ltd", "limited", "private", "pvt", "llp", "lp", "plc", "holdings", "enterprises",
    "sarl", "sas", "sasu", "sa", "sci", "eurl", "snc", "societe", "cie",
)
GENERIC_WORDS = (
    "road", "street", "avenue", "boulevard", "drive", "lane", "highway", "floor", "building", "apartment", "plot", "house", "number", "near", "opposite",
    "sector", "block", "phase", "chowk", "market", "complex", "tower", "enclave", "colony",
)
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
INDIAN_STATES = (
    "maharashtra gujarat karnataka tamilnadu telangana andhra kerala punjab haryana rajasthan uttar pradesh madhya bihar west bengal odisha assam "
    "jharkhand chhattisgarh goa delhi hyderabad mumbai pune bangalore chennai kolkata"
).split()
SEED_NAMES = {
    "pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company", "intl": "international", "mfg": "manufacturing",
    "assn": "association", "govt": "government", "dept": "department", "natl": "national", "cie": "compagnie", "ste": "societe", "ets": "etablissements",
    "svc": "service", "svcs": "services", "grp": "group", "hosp": "hospital", "univ": "university", "sch": "school",
}
SEED_ADDRESSES = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway", "opp": "opposite", "nr": "near",
    "bd": "boulevard", "av": "avenue", "ch": "chemin", "pl": "place", "hn": "house number", "hno": "house number", "h no": "house number",
    "s no": "survey number", "kh no": "khasra number", "plot no": "plot number", "shp no": "shop number", "shop no": "shop number", "sec": "sector",
    "flr": "floor", "bldg": "building", "apt": "apartment", "flat": "flat", "door": "door",
}
#: Replacements of the phonetic key, applied in this order, and skeletons of legal forms that it drops.
PHONETIC = (
    ("sh", "s"), ("ch", "k"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ph", "p"), ("jh", "j"), ("ck", "k"),
    ("f", "p"), ("v", "b"), ("w", "b"), ("c", "k"), ("q", "k"), ("z", "j"), ("x", "ks"),
)
PHONETIC_LEGAL = ("prbt", "prbr", "pbt", "lmtd", "lmt", "ltd", "lmrd", "llp", "ink", "inkrprtd", "kmpn", "krprtn", "krp", "ko")
STOP_INITIALS = ("of", "the", "and", "for", "in")
DOMAIN = r"(?i)\b([A-Za-z0-9\-]+\.(?:com|net|org|in|fr|co|io|us))\b"
LANDMARK = r"(?i)(\b(?:near|opposite|opp\.?|behind|beside|next\s+to|in\s+front\s+of|landmark)\b[^,]*)"
HOUSE_LABEL = r"(?i)\b(?:h\.?\s*no|hno|plot\s*no|shp\s*no|shop\s*no|kh\.?\s*no|s\.?\s*no|door|flat)\b\.?\s*[:.-]?\s*([\dA-Za-z][\dA-Za-z/\-]*)"
LEADING_WORD = r"^\s*([\dA-Za-z][\dA-Za-z/\-]*)\s+(?=[A-Za-z])"
LEADING_NUMBER = r"^\s*(\d[\dA-Za-z/\-]*)\s+(?=[A-Za-z])"
NUMBER = r"(\b\d[\dA-Za-z/\-]*\b)"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """The words between white space, blanks dropped."""
    return F.filter(F.split(text(c), r"\s+"), lambda x: x != "")


def joined(c: Column) -> Column:
    return F.array_join(c, " ")


def without(c: Column, pattern: str, new: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(new))


def squeezed(c: Column) -> Column:
    return F.trim(without(c, r"\s+", " "))


def strip_junk(c: Column | str) -> Column:
    """Cut from the first pipe on, then signs at both ends off."""
    cut = without(text(c), r"\s*\|.*$")
    return without(without(cut, r"^[^\p{L}\p{N}]+"), r"[^\p{L}\p{N}]+$")


def basic_clean(c: Column | str) -> Column:
    """Junk cut, & and @ spelled out, all signs but / - . , dropped, single spaces. Expects an NFKC form."""
    spelled = F.replace(F.replace(strip_junk(c), F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    return squeezed(without(spelled, r"[^\p{L}\p{N}_\s/\-.,&@]", " "))


def once_in_a_row(words: Column) -> Column:
    """The words without direct repeats. Each word meets the one before it in a zip, so the array is made once."""
    before = F.concat(F.array(F.lit(None).cast("string")), words)
    return F.array_compact(F.zip_with(words, before, lambda w, b: F.when(b.isNull() | (w != b), w)))


def domain_parts(c: Column | str) -> Column:
    """Struct of name (without the first domain), domain (its stub), from_domain (the stub if nothing else is there)."""
    value = text(c)
    found = F.regexp_extract(value, DOMAIN, 1)
    stub = without(without(F.lower(found), r"^www\."), r"\.[^.]*$")
    at = F.regexp_instr(value, F.lit(DOMAIN))
    rest = F.trim(F.concat(F.substring(value, F.lit(1), at - 1), F.lit(" "), F.substring(value, at + F.length(found), F.length(value))))
    none = found == ""
    return F.struct(
        F.when(none, value).when(rest == "", stub).otherwise(rest).alias("name"),
        F.when(none, "").otherwise(stub).alias("domain"),
        F.when(none | (rest != ""), "").otherwise(stub).alias("from_domain"),
    )


def expanded(words: Column, mapping: Mapping[str, str]) -> Column:
    """Abbreviations spelled out from left to right, keys of two words before those of one; what is written is not expanded again."""
    if not mapping:
        return joined(words)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    starts = sorted({k.split()[0] for k in mapping if " " in k})

    def step(state: Column, word: Column) -> Column:
        two = F.concat_ws(" ", state["held"], word)
        pair = F.try_element_at(table, two)
        single = F.coalesce(F.try_element_at(table, state["held"]), state["held"])
        waits = word.isin(starts) if starts else F.lit(False)
        alone = F.coalesce(F.try_element_at(table, word), word)
        return (
            F.when(state["held"].isNotNull() & pair.isNotNull(), F.struct(F.concat(state["out"], F.array(pair)).alias("out"), F.lit(None).cast("string").alias("held")))
            .when(state["held"].isNotNull() & waits, F.struct(F.concat(state["out"], F.array(single)).alias("out"), word.alias("held")))
            .when(state["held"].isNotNull(), F.struct(F.concat(state["out"], F.array(single), F.array(alone)).alias("out"), F.lit(None).cast("string").alias("held")))
            .when(waits, F.struct(state["out"].alias("out"), word.alias("held")))
            .otherwise(F.struct(F.concat(state["out"], F.array(alone)).alias("out"), F.lit(None).cast("string").alias("held")))
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def finish(state: Column) -> Column:
        last = F.when(state["held"].isNotNull(), F.array(F.coalesce(F.try_element_at(table, state["held"]), state["held"]))).otherwise(F.array().cast("array<string>"))
        return joined(F.concat(state["out"], last))

    return F.aggregate(words, start, step, finish)


def split_legal(words: Column) -> Column:
    """Struct of core and suffix: legal words peeled off the right end; the suffix sorted and distinct."""
    last = F.array_max(F.transform(words, lambda x, i: F.when(~x.isin(*LEGAL_WORDS), i + 1).otherwise(0)))
    n = F.coalesce(last, F.lit(0))
    core, tail = F.slice(words, F.lit(1), n), F.slice(words, n + 1, F.size(words) - n)
    return F.struct(core.alias("core"), joined(F.array_sort(F.array_distinct(tail))).alias("suffix"))


def acronym(words: Column) -> Column:
    kept = F.filter(words, lambda x: ~x.isin(*STOP_INITIALS))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, 1, 1)), "")


def landmarks(c: Column | str) -> Column:
    """Struct of rest and found (phrases joined by ' | ')."""
    value = text(c)
    found = F.array_join(F.transform(F.regexp_extract_all(value, F.lit(LANDMARK), F.lit(1)), lambda x: F.trim(x)), " | ")
    rest = without(without(squeezed(without(value, LANDMARK, " ")), r"^[ ,]+"), r"[ ,]+$")
    return F.struct(F.when(value == "", "").otherwise(rest).alias("rest"), found.alias("found"))


def postal(c: Column | str) -> Column:
    """Struct of code, prefix and rest. The last 'ddd ddd' wins and goes wherever it stands; else the last run of 5 or 6 digits, and all such runs go."""
    value = text(c)
    spaced = F.regexp_extract_all(value, F.lit(r"(?<!\d)(\d{3}\s+\d{3})(?!\d)"), F.lit(1))
    plain = F.regexp_extract_all(value, F.lit(r"(?<!\d)(\d{5,6})(?!\d)"), F.lit(1))
    last, other = F.try_element_at(spaced, F.lit(-1)), F.try_element_at(plain, F.lit(-1))
    code = F.coalesce(F.replace(last, F.lit(" "), F.lit("")), other, F.lit(""))
    rest = F.when(last.isNotNull(), F.replace(value, last, F.lit(" "))).when(other.isNotNull(), without(value, r"(?<!\d)(\d{5,6})(?!\d)", " ")).otherwise(value)
    return F.struct(code.alias("code"), F.substring(code, 1, 3).alias("prefix"), rest.alias("rest"))


def house(c: Column | str, strict: bool = False) -> Column:
    """Struct of house and rest: a labelled number, else the leading word; ``strict`` asks that word to start with a digit."""
    value, leading = text(c), LEADING_NUMBER if strict else LEADING_WORD
    label, lead = F.regexp_instr(value, F.lit(HOUSE_LABEL)), F.regexp_instr(value, F.lit(leading))
    whole = F.regexp_substr(value, F.lit(HOUSE_LABEL))
    labelled = F.concat(F.substring(value, F.lit(1), label - 1), F.lit(" "), F.substring(value, label + F.length(whole), F.length(value)))
    found = F.when(label > 0, F.regexp_extract(value, HOUSE_LABEL, 1)).when(lead > 0, F.regexp_extract(value, leading, 1)).otherwise("")
    rest = F.when(label > 0, labelled).when(lead > 0, without(value, leading)).otherwise(value)
    return F.struct(F.upper(F.replace(found, F.lit(" "), F.lit(""))).alias("house"), rest.alias("rest"))


def _dots_off(c: Column) -> Column:
    return without(without(c, r"^\.+"), r"\.+$")


def locality(c: Column | str) -> Column:
    """Struct of words (of the last three comma parts, letters only, not generic) and state (of the last part that has one)."""
    parts = F.filter(F.transform(F.split(text(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    tail = F.when(F.size(parts) > 3, F.slice(parts, F.size(parts) - 2, F.lit(3))).otherwise(parts)
    words = F.transform(F.flatten(F.transform(tail, tokens)), lambda w: _dots_off(F.lower(w)))
    kept = F.filter(words, lambda w: w.rlike(r"^\p{L}+$") & ~w.isin(*GENERIC_WORDS))

    def state(sofar: Column, part: Column) -> Column:
        raw = tokens(part)
        us = F.get(F.filter(F.transform(raw, lambda w: _dots_off(F.upper(w))), lambda w: w.isin(*US_STATES)), F.lit(0))
        indian = F.get(F.filter(F.transform(raw, F.lower), lambda w: w.isin(*INDIAN_STATES)), F.lit(0))
        return F.coalesce(us, F.when(sofar == "", F.coalesce(indian, F.lit(""))).otherwise(sofar))

    return F.struct(kept.alias("words"), F.aggregate(tail, F.lit(""), state).alias("state"))


def street_words(c: Column | str, house_number: Column, postal_code: Column, locality_words: Column) -> Column:
    words = F.transform(F.filter(F.split(text(c), r"[\s,]+"), lambda w: w != ""), lambda w: _dots_off(F.lower(w)))
    drop = lambda w: (w == "") | F.array_contains(locality_words, w) | (w == F.lower(house_number)) | (w == postal_code) | w.isin(*GENERIC_WORDS) | w.rlike(r"^\d+$")
    return F.filter(words, lambda w: ~drop(w))


def numbers(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(NUMBER), F.lit(1))


def phonetic(words: Column) -> Column:
    """The consonant skeletons of the words, those of legal forms dropped."""

    def skeleton(w: Column) -> Column:
        w = without(w, r"m(?=[^aeiouym])", "n")
        for a, b in PHONETIC:
            w = F.replace(w, F.lit(a), F.lit(b))
        rest = without(F.substring(w, F.lit(2), F.length(w)), "[aeiouy]")
        return without(F.concat(F.substring(w, 1, 1), rest), r"(.)\1+", "$1")

    return joined(F.filter(F.transform(words, skeleton), lambda w: (w != "") & ~w.isin(*PHONETIC_LEGAL)))


def trigrams(c: Column | str) -> Column:
    """The distinct substrings of three characters; none of shorter text."""
    value = text(c)
    n = F.length(value) - 2
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(value, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
