"""Profiling aggregations over records and true pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def match_cardinality(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distribution of the number of matches of an entity (s1_id): one row a number, with the overall figures beside."""
    counts = entities.join(pairs.groupBy("s1_id").count(), "s1_id", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    overall = counts.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("least"), *[F.expr(f"percentile(n, {q})").alias(c) for c, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], F.max("n").alias("most"), F.avg((F.col("n") == 0).cast("double")).alias("singletons"))
    return counts.groupBy("n").agg(F.count("*").alias("entities")).crossJoin(F.broadcast(overall))  # one row


def exclusivity(pairs: DataFrame) -> DataFrame:
    """Candidates that more than one entity claims, and their share of all."""
    claims = pairs.groupBy("cand_id").agg(F.countDistinct("s1_id").alias("k"))
    return claims.agg(F.count("*").alias("candidates"), F.count_if(F.col("k") > 1).alias("shared"), F.avg((F.col("k") > 1).cast("double")).alias("share"))


def cross_partition_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs whose sides are of different countries, or of an unknown one."""
    side = records.select(F.col("entity_id"), "country")
    both = pairs.join(side.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country")), "s1_id", "left").join(side.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("cand_country")), "cand_id", "left")
    return both.where(~F.coalesce(F.col("s1_country") == F.col("cand_country"), F.lit(False))).select("s1_id", "cand_id", "s1_country", "cand_country")


def source_sizes(records: DataFrame) -> DataFrame:
    """Rows of each country in each source, and the pairs that comparing all would take."""
    n = lambda *s: F.count_if(F.col("source").isin(*s))
    return records.groupBy("country").agg(n(1).alias("s1"), n(2).alias("s2"), n(3).alias("s3"), (n(1) * n(2, 3)).alias("naive_pairs"))


def chain_names(names: DataFrame, quantile: float = 0.999) -> DataFrame:
    """Names (column name) whose count reaches the quantile of all counts."""
    counts = names.groupBy("name").agg(F.count("*").alias("n"))
    bar = counts.agg(F.expr(f"percentile(n, {quantile})").alias("bar"))
    return counts.crossJoin(F.broadcast(bar)).where("n >= bar").select("name", "n")


def common_names(names: DataFrame, n: int = 25) -> DataFrame:
    """The n most frequent names of each source (columns name, source); of equals the smaller name."""
    counts = names.where("name is not null").groupBy("source", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.col("n").desc(), "name")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def partition_values(records: DataFrame) -> DataFrame:
    """The distinct countries of each source, null and blank ones as they are, with their rows."""
    return records.groupBy("source", "country").agg(F.count("*").alias("n"))


def missing_partition(records: DataFrame) -> DataFrame:
    """Share of rows without a country by source, and the number of countries."""
    blank = F.col("country").isNull() | (F.trim("country") == "")
    return records.groupBy("source").agg(F.count("*").alias("n"), F.avg(blank.cast("double")).alias("missing"), F.countDistinct("country").alias("countries"))


def has_postal(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?<!\d)\d{5,6}(?!\d)")


def has_house(c: Column) -> Column:
    """A labelled house number, or a leading word before another one."""
    value = F.coalesce(c, F.lit(""))
    return value.rlike(X.HOUSE_LABEL) | value.rlike(X.LEADING_WORD)


def coverage(records: DataFrame, **predicates: Column) -> DataFrame:
    """Share of rows for which each predicate holds, by country."""
    return records.groupBy("country").agg(F.count("*").alias("n"), *[F.avg(p.cast("double")).alias(k) for k, p in predicates.items()])


def script_shares(records: DataFrame, script: str = "name_script") -> DataFrame:
    """Share of each script in each country."""
    counts = records.groupBy("country", script).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("country")))


def name_duplication(records: DataFrame) -> DataFrame:
    """Lower-cased names that occur more than once: names, records, share of records, by country."""
    counts = records.groupBy("country", F.lower(F.trim("name")).alias("k")).agg(F.count("*").alias("n"))
    repeated = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    return counts.groupBy("country").agg(F.count_if(F.col("n") > 1).alias("names"), F.sum(repeated).alias("rows"), (F.sum(repeated) / F.sum("n")).alias("share"))


def source_asymmetry(pairs: DataFrame, records: DataFrame, similarity, most: int | None = None) -> DataFrame:
    """Similarity of the lower-cased names of true pairs by the candidate's source: n, mean, quartiles. ``most``: only so many pairs, the least by a hash."""
    if most is not None:
        pairs = pairs.orderBy(F.md5(F.concat_ws("|", "s1_id", "cand_id"))).limit(most)
    side = lambda i, n: records.select(F.col("entity_id").alias(i), F.lower("name").alias(n), F.col("source").alias(f"{n}_source"))
    both = pairs.join(side("s1_id", "a"), "s1_id").join(side("cand_id", "b"), "cand_id").select(F.col("b_source").alias("source"), similarity("a", "b").alias("sim"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), *[F.expr(f"percentile(sim, {q / 100})").alias(f"p{q}") for q in (25, 50, 75)])


def matches_by_source(pairs: DataFrame) -> DataFrame:
    """Pairs by the prefix of the candidate's id, and their share."""
    counts = pairs.groupBy(F.substring_index("cand_id", "-", 1).alias("prefix")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
