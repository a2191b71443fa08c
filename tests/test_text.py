"""Hand-worked cases of the normalisation, each by its expected value."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.functions.unicode import romanised, script_of
from tessera.operators import blocking, corpus
from tessera.operators.records import normalised


def value(spark, column, **inputs):
    rows = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in inputs.items()))
    got = rows.select(column.alias("x")).first().x
    return tuple(got) if hasattr(got, "asDict") else got


@pytest.mark.parametrize(
    "column, text, want",
    [
        (lambda: X.basic_clean("t"), "-- A & B @ C | www.x.com", "A and B at C"),
        (lambda: X.basic_clean("t"), None, ""),
        (lambda: X.joined(X.once_in_a_row(X.tokens("t"))), "odyssey odyssey llc odyssey", "odyssey llc odyssey"),
        (lambda: X.domain_parts("t"), "earnosethroat.com", ("earnosethroat", "earnosethroat", "earnosethroat")),
        (lambda: X.domain_parts("t"), "shop at x.co.uk now", ("shop at  .uk now", "x", "")),
        (lambda: X.acronym(X.tokens("t")), "state bank of india", "sbi"),
        (lambda: X.postal("t"), "plot 5 400 001 x 12345", ("400001", "400", "plot 5   x 12345")),
        (lambda: X.postal("t"), "12345 main st 90210", ("90210", "902", "  main st  ")),
        (lambda: X.house("t"), "105 elm street", ("105", "elm street")),
        (lambda: X.house("t"), "main street", ("MAIN", "street")),
        (lambda: X.house("t"), "house number 204 x", ("HOUSE", "number 204 x")),
        (lambda: X.house("t"), "h.no 204", ("204", " ")),
        (lambda: X.house("t", strict=True), "main street", ("", "main street")),
        (lambda: X.expanded(X.tokens("t"), X.SEED_ADDRESSES), "h no 4 nr rd", "house number 4 near road"),
        (lambda: X.expanded(X.tokens("t"), {"h no": "A", "no": "B", "h": "C"}), "h h no no h", "C A B C"),
        (lambda: X.landmarks("t"), "12 x, near the mill , y, opp. z", ("12 x, , y", "near the mill | opp. z")),
        (lambda: X.phonetic(X.tokens("t")), "sivama inphoteka", "sbm inptk"),
        (lambda: X.phonetic(X.tokens("t")), "shivam infotech", "sbm inptk"),
        (lambda: X.phonetic(X.tokens("t")), "tata ltd", "t"),
        (lambda: X.numbers("t"), "12/b x 7-c y9 9", ["12/b", "7-c", "9"]),
        (lambda: blocking.longest_word(X.tokens("t")), "aa bbb ccc", "bbb"),
    ],
)
def test_cases(spark, column, text, want):
    assert value(spark, column(), t=text) == want


def test_legal_and_locality(spark):
    got = value(spark, X.split_legal(X.tokens("t")), t="shiva traders private limited")
    assert (list(got[0]), got[1]) == (["shiva", "traders"], "limited private")
    assert value(spark, X.split_legal(X.tokens("t")), t="ltd ltd")[1] == "ltd"
    words, state = value(spark, X.locality("t"), t="1 a, b road, pune, TX. 75001")
    assert (list(words), state) == (["b", "pune", "tx"], "TX")
    assert value(spark, X.locality("t"), t="x, pune")[1] == "pune"


def test_scripts_and_romanisation():
    assert [script_of(x) for x in ("", "12-3.", "Café", "राम ab", "中文", "тест")] == ["empty", "empty", "latin", "devanagari", "other", "other"]
    assert romanised("राम", "devanagari") == "rāma" and romanised("हिन्दी", "devanagari") == "hindī" and romanised("தமிழ்", "tamil") == "tamiḻ"
    assert romanised("Ωé", "other") == "e"


def test_similarities(spark):
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and S.jaro_winkler_of("", "") == 0.0
    assert S.jaro_winkler_of("abcd", "axyz") == pytest.approx(0.5)
    assert S.ratio_of("abc", "abd") == pytest.approx(2 / 3) and S.token_sort_of("b a", "a b") == 1.0
    assert S.token_set_of("a b", "a b c") == 1.0 and S.token_set_of("", "a") == 0.0
    assert S.partial_of("abc", "xxabcxx") == 1.0
    assert value(spark, S.jaccard(X.trigrams("a"), X.trigrams("b"), 1.0), a="ab", b="ab") == 1.0
    assert value(spark, S.jaccard(X.trigrams("a"), X.trigrams("b"), 1.0), a="ab", b="abc") == 0.0
    assert value(spark, S.jaccard(X.tokens("a"), X.tokens("b"), 0.0), a="", b="") == 0.0
    assert value(spark, S.levenshtein(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert value(spark, S.equal(F.col("a"), F.col("b")), a=None, b=None) == 0
    assert [value(spark, S.legal_state(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("", ""), ("x", "x"), ("x", ""), ("x", "y"))] == [0, 1, 2, 3]


def test_subsequences(spark):
    for short, long, want in (("pvt", "private", True), ("mfg", "manufacturing", True), ("abc", "acb", False), ("abc", "abc", False)):
        assert value(spark, corpus.is_subsequence(F.col("a"), F.col("b")), a=short, b=long) is want


def test_normalised_rows_without_country_or_text(spark):
    rows = spark.createDataFrame([("S1-1", None, "", None), ("S1-2", "ACME Pvt. Ltd | x", "h no 4, nr mill, pune 400 001", "India")], "entity_id string, name string, address string, country string")
    got = {r.entity_id: r for r in normalised(rows).collect()}
    assert got["S1-1"].country == "__none__" and got["S1-1"].core_name == "" and got["S1-1"].address_missing == 1
    assert got["S1-2"].postal_code == "400001" and got["S1-2"].legal_suffix == "limited" and len(got["S1-2"]) == 32
