"""Sources and sinks: tab-separated records, ground truth, id lists, parquet by partition, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORDS) -> DataFrame:
    """A tab-separated file with a header and no quoting; every column a string, only the empty field is null."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", nullValue="", emptyValue="")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth; an empty list stays an empty string."""
    return read_tsv(spark, path, TRUTH).withColumn("matched_entity_ids", F.coalesce("matched_entity_ids", F.lit("")))


def id_list(c: Column | str) -> Column:
    """The ids of a comma-joined list, trimmed, blanks dropped; none for null."""
    value = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def explode_truth(truth: DataFrame) -> DataFrame:
    """One row a pair: source1_entity_id, matched_id."""
    return truth.select("source1_entity_id", F.explode(id_list("matched_entity_ids")).alias("matched_id"))


def id_lists(entities: DataFrame, pairs: DataFrame, id_column: str = "matched_entity_ids", order: Column | None = None) -> DataFrame:
    """One row for each entity (source1_entity_id): its ids from pairs (s1_id, cand_id) in the given order, repeats dropped, comma-joined, empty without any."""
    ranked = pairs.groupBy("s1_id", "cand_id").agg(F.min(order if order is not None else F.col("cand_id")).alias("o"))
    lists = ranked.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "cand_id"))), lambda x: x["cand_id"]), ",").alias(id_column))
    return entities.select("source1_entity_id").join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select("source1_entity_id", F.coalesce(id_column, F.lit("")).alias(id_column))


def write_id_lists(lists: DataFrame, path: str) -> None:
    """Writes id lists as tab-separated text; fails if an entity has two rows."""
    if not lists.groupBy("source1_entity_id").count().where("count > 1").isEmpty():
        raise ValueError("an entity has more than one row")
    lists.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def read_id_lists(spark: SparkSession, path: str, id_column: str = "matched_entity_ids") -> DataFrame:
    """source1_entity_id and ids (array); fails on another header."""
    found = spark.read.csv(path, sep="\t", header=True, quote="", nullValue="")
    if found.columns != ["source1_entity_id", id_column]:
        raise ValueError(f"unexpected header {found.columns}")
    return found.select("source1_entity_id", id_list(id_column).alias("ids"))


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet under one folder for each value of the partition columns, which scans prune by."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def source_prefix(c: Column | str) -> Column:
    """What stands before the first hyphen of an id; empty without a hyphen."""
    value = F.col(c) if isinstance(c, str) else c
    return F.when(F.instr(value, "-") > 0, F.substring_index(value, "-", 1)).otherwise("")


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in a given order, all without n."""
    return df if n is None else df.orderBy(*order).limit(n)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)
