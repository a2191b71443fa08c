"""Records: the view of them that the driver's documents give, and the normalised form with its 28 derived columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.unicode import plain_lower, read_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, source (1 to 3), name, address, country, doc_id of every document: words 1 to 6 are its name, 7 to 18 its address."""
    # the first piece may be empty, the last one is the rest of the text
    words = F.filter(F.split("text", r"[ \t\n\r]+", 20), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("t"), (F.col("doc_id") % 3 + 1).alias("source"))
    return docs.select(
        F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("entity_id"),
        "source",
        F.array_join(F.slice("t", 1, 6), " ").alias("name"),
        F.array_join(F.slice("t", 7, 12), " ").alias("address"),
        F.col("lang").alias("country"),
        "doc_id",
    )


def true_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, cand_id of documents of source 1 and of sources 2 or 3 with one text; digests stand for the texts in the shuffle."""
    docs = table(spark, sf_dir, "documents")
    source = F.col("doc_id") % 3 + 1
    ids = docs.select(F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), source.alias("source"), F.sha2("text", 256).alias("h"))
    left, right = ids.where("source = 1").select(F.col("id").alias("s1_id"), "h"), ids.where("source > 1").select(F.col("id").alias("cand_id"), "h")
    return left.join(right, "h").select("s1_id", "cand_id")


def truth_lists(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """s1_id and its true ids, empty for singletons."""
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list("cand_id")).alias("ids"))
    return entities.join(lists, "s1_id", "left").select("s1_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def normalised(rows: DataFrame, name_map: Mapping[str, str] = X.SEED_NAMES, address_map: Mapping[str, str] = X.SEED_ADDRESSES, strict_house: bool = False) -> DataFrame:
    """``rows`` with the derived columns of their name and address, each step a projection; rows without a country go to '__none__'."""
    df = rows.withColumns({"_n": read_text(X.text("name")), "_a": read_text(X.text("address")), "country": F.coalesce("country", F.lit("__none__"))})
    df = df.withColumns({"_nw": X.tokens(plain_lower(X.basic_clean("_n.roman"))), "_aw": X.tokens(plain_lower(X.basic_clean("_a.roman")))})
    df = df.withColumns({"_nc": X.once_in_a_row(F.col("_nw")), "_ac": X.joined(X.once_in_a_row(F.col("_aw")))})
    df = df.withColumns({"name_clean": X.joined(F.col("_nc")), "_lm": X.landmarks("_ac")})
    df = df.withColumn("_d", X.domain_parts("name_clean"))
    # without anything to expand the spacing that the domain left behind stays, else words are set anew
    df = df.withColumns({"name_expanded": X.expanded(X.tokens("_d.name"), name_map), "address_expanded": X.expanded(X.tokens("_lm.rest"), address_map)})
    df = df.withColumns({"_l": X.split_legal(X.tokens("name_expanded")), "_p": X.postal("address_expanded")})
    df = df.withColumn("_h", X.house("_p.rest", strict_house))
    df = df.withColumn("_loc", X.locality("_h.rest"))
    street = X.street_words("_h.rest", F.col("_h.house"), F.col("_p.code"), F.col("_loc.words"))
    flag = lambda c: (c == "").cast("int")
    return df.select(
        *rows.drop("country").columns,
        "country",
        F.col("_n.script").alias("name_script"),
        F.col("_a.script").alias("address_script"),
        F.col("_n.roman").alias("name_roman"),
        F.col("_a.roman").alias("address_roman"),
        "name_clean",
        "name_expanded",
        X.joined(F.col("_l.core")).alias("core_name"),
        F.col("_l.suffix").alias("legal_suffix"),
        F.col("_d.domain").alias("name_domain"),
        F.col("_d.from_domain").alias("name_from_domain"),
        X.acronym(F.col("_l.core")).alias("acronym"),
        X.joined(F.array_sort("_l.core")).alias("name_sorted"),
        (F.size("_nc") < F.size("_nw")).cast("int").alias("name_had_repeat"),
        (F.col("name_expanded") != F.col("_d.name")).cast("int").alias("expansion_changed_name"),
        F.least("_n.ok", "_a.ok").alias("romanization_ok"),
        "address_expanded",
        F.col("_lm.found").alias("landmark_text"),
        F.col("_p.code").alias("postal_code"),
        F.col("_p.prefix").alias("postal_prefix3"),
        F.col("_h.house").alias("house_number"),
        X.joined(X.numbers("address_expanded")).alias("all_numbers"),
        X.joined(F.col("_loc.words")).alias("locality_tokens"),
        F.col("_loc.state").alias("state_code"),
        X.joined(street).alias("street_tokens"),
        flag(F.col("_ac")).alias("address_missing"),
        flag(F.col("_p.code")).alias("postal_missing"),
        flag(F.col("_h.house")).alias("house_number_missing"),
        (F.size("_loc.words") == 0).cast("int").alias("locality_missing"),
    )


def dense_text(core: str = "core_name", roman: str = "name_roman", raw: str = "name", address: str = "address_expanded"):
    """What an encoder reads: the first name that is not empty, a pipe, the address."""
    first = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in (core, roman, raw)], F.lit(""))
    return F.regexp_replace(F.concat(first, F.lit(" | "), X.text(address)), r"^[ |]+|[ |]+$", "")


def pair_text(name: str, address: str, original: str, script: str):
    """What a cross-encoder reads of a record; names in other scripts come first in their own."""
    shown = F.when(F.col(script) != "latin", F.concat(F.col(original), F.lit(" ("), F.col(name), F.lit(")"))).otherwise(F.col(name))
    return F.concat(shown, F.lit(" | "), X.text(address))
