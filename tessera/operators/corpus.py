"""Corpus statistics and the mining of abbreviations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def token_idf(rows: DataFrame, words: Column) -> DataFrame:
    """ln(1 + N/df) of each word by country; N counts all rows of the country, df those that hold the word."""
    pairs = rows.select("country", F.explode(F.array_distinct(words)).alias("token"))
    df = pairs.groupBy("country", "token").agg(F.count("*").alias("df"))
    n = rows.groupBy("country").agg(F.count("*").alias("n"))
    return df.join(n, "country").select("country", "token", F.log1p(F.col("n") / F.col("df")).alias("idf"))


def name_frequency(rows: DataFrame, name: str = "core_name") -> DataFrame:
    """Rows of each name by country, the empty name too."""
    return rows.groupBy("country", F.coalesce(name, F.lit("")).alias("name")).agg(F.count("*").alias("freq"))


def is_prefix(short: Column, long: Column) -> Column:
    return (F.length(short) < F.length(long)) & F.startswith(long, short)


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` occur in ``long`` in that order; strictly shorter."""
    letters = F.filter(F.split(short, ""), lambda c: c != "")
    rest = F.aggregate(letters, long, lambda left, c: F.when(F.instr(left, c) > 0, F.substr(left, F.instr(left, c) + 1)).otherwise(F.lit(None).cast("string")))
    return (F.length(short) < F.length(long)) & rest.isNotNull()


def abbreviation_pairs(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    """(short, long, n) over the word pairs of true pairs, in both directions: short of 2 to 5 letters, a prefix or subsequence of long.

    The theta join is of two short arrays in one row; nothing global is compared.
    """
    words = pairs.select(left.alias("a"), right.alias("b"))
    both = words.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("l")), F.struct(F.col("b").alias("s"), F.col("a").alias("l")))).alias("x"))
    each = both.select(F.explode("x.s").alias("short"), F.col("x.l").alias("ls")).where(F.length("short").between(2, 5)).select("short", F.explode("ls").alias("long"))
    fits = F.col("short") != F.col("long")
    return each.where(fits & (is_prefix(F.col("short"), F.col("long")) | is_subsequence(F.col("short"), F.col("long")))).groupBy("short", "long").agg(F.count("*").alias("n"))


def accepted(counts: DataFrame, min_count: int = 5, dominance: float = 0.70, by: tuple[str, ...] = ()) -> DataFrame:
    """The top long form of each short one whose total reaches min_count and whose share reaches dominance; of equals the first by code point."""
    w = Window.partitionBy(*by, "short")
    ranked = counts.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.col("n").desc(), "long"))})
    return ranked.where((F.col("r") == 1) & (F.col("total") >= min_count) & (F.col("n") / F.col("total") >= dominance)).select(*by, "short", "long")


def slot_pairs(rows: DataFrame, words: Column, min_freq: int = 10) -> DataFrame:
    """(country, short, long, n): words of 2 to 5 letters and frequent longer ones (over 5) in the same first or last place."""
    slots = rows.select("country", words.alias("t")).where(F.size("t") > 0)
    each = slots.select("country", F.explode(F.array(F.struct(F.lit("first").alias("slot"), F.get("t", F.lit(0)).alias("w")), F.struct(F.lit("last").alias("slot"), F.element_at("t", -1).alias("w")))).alias("x")).select("country", "x.slot", "x.w")
    counts = each.groupBy("country", "slot", "w").agg(F.count("*").alias("c")).where(F.col("c") >= min_freq)
    short = counts.where(F.length("w").between(2, 5)).select("country", "slot", F.col("w").alias("short"))
    long = counts.where(F.length("w") > 5).select("country", "slot", F.col("w").alias("long"))
    fits = is_prefix(F.col("short"), F.col("long")) | is_subsequence(F.col("short"), F.col("long"))
    return short.join(long, ["country", "slot"]).where(fits).groupBy("country", "short", "long").agg(F.count("*").alias("n"))


def seed(spark: SparkSession, mapping: Mapping[str, str] = X.SEED_NAMES) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "short string, long string")


def merged(layers: list[DataFrame]) -> DataFrame:
    """Layers of (short, long), later ones on top: a new key is added, a conflicting one deleted, which a third layer may add again."""
    out = layers[0]
    for layer in layers[1:]:
        both = out.select("short", F.col("long").alias("old")).join(layer.select("short", F.col("long").alias("new")), "short", "full_outer")
        out = both.where(F.col("old").isNull() | F.col("new").isNull() | (F.col("old") == F.col("new"))).select("short", F.coalesce("old", "new").alias("long"))
    return out


def dictionary(spark: SparkSession, seeds: Mapping[str, str], counts: DataFrame, slots: DataFrame, min_count: int = 5, dominance: float = 0.70) -> DataFrame:
    """The abbreviations (short, long) of all layers: seeds, those of the slots of each country, those mined from true pairs."""
    by_slot = accepted(slots, 1, dominance, ("country",)).select("short", "long").distinct()
    # a short form that two countries spell out differently stays out
    clear = by_slot.groupBy("short").agg(F.min("long").alias("long"), F.count("*").alias("k")).where("k = 1").select("short", "long")
    return merged([seed(spark, seeds), clear, accepted(counts, min_count, dominance)])


def as_mapping(layer: DataFrame, most: int = 100_000) -> dict[str, str]:
    """A dictionary for ``text.expanded``; fails rather than bring more than ``most`` entries to the driver."""
    rows = layer.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} abbreviations")
    return {r.short: r.long for r in rows}
