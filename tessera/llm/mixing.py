"""Mixing of sources to target weights by Sainte-Lague apportionment.

The documents of a shard and source are laid out in a seeded order and cut into blocks of equal numbers of words. Each
shard's blocks are apportioned among the sources by the highest quotients target/(2k + 1), which gives integer quotas, and
each quota is filled with blocks from a seeded start on, around the layout and up to ``most`` times around.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, cut, spread, table

#: Weights of the sources in the order of their names, repeating; the words shared, of all; how often a word is taken at most.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
BLOCK, SHARD_ROWS, SEED = 16, 4096, 42
_WORD = r"[^\x20\x09-\x0D]+"


def words(text_col: str) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (one row a source: name, source_size) with target double.

    ``share`` times all words go to the sources by weight; a target stops at ``most`` times its source's size, and the
    excess is shared by weight among the rest until none is above. In the order of size per weight those that stop come
    first, so prefix sums find where they end. Names sort by code point, null last.
    """
    order = Window.orderBy(F.col("name").asc_nulls_last())
    cap = F.col("source_size") * F.lit(float(most))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumns({"weight": weight, "cap": cap})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("name").asc_nulls_last())
    earlier, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    # level: words per weight if all earlier ones stop and no other does; the first that does not stop has the right one
    rows = rows.withColumns({"place": F.row_number().over(by_ratio), "level": left / weight_left})
    goes_on = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    level = F.min(goes_on).over(everything)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("name", "source_size", "target")


def apportioned(weights: list[float], caps: list[int], house: int) -> list[int]:
    """Integer seats by the highest quotients weight/(2k + 1), at most cap each; equal quotients go to the earlier one.

    Each starts with the seats that it has in any case: the last quotient's divisor is at most total/(house - n/2) for n
    weights, and seats are the rounded weight/divisor. So the queue deals out about 2n seats, however large the house.
    """
    total, n = sum(weights), len(weights)
    if total <= 0 or house <= 0:
        return [0] * n
    house = min(house, sum(c for w, c in zip(weights, caps) if w > 0))
    seats = [min(c, max(0, int(w * (house - n / 2) / total - 1.5))) if w > 0 else 0 for w, c in zip(weights, caps)]
    queue = [(-w / (2 * s + 1), i) for i, (w, s, c) in enumerate(zip(weights, seats, caps)) if w > 0 and s < c]
    heapq.heapify(queue)
    for _ in range(house - sum(seats)):
        _, i = heapq.heappop(queue)
        seats[i] += 1
        if seats[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * seats[i] + 1), i))
    return seats


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, shard_rows: int, seed: int, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """row (all columns of ``docs``) and mix, as ``mixed`` describes it. The document's columns stay inside ``row``, so that they can have any names."""
    key = F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit(""))
    same = F.xxhash64(F.lit(seed), col(id_col).cast("long"), col(text_col))
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), words(text_col).alias("size"), key.alias("key"), same.alias("same"), col(id_col).alias("id"))
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.withColumn("order", spread(F.col("same"), rows, "same")).drop("same")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("order"), F.lit(shards)))
    parts = cut(rows.groupBy("key", "shard").agg(F.sum("size").alias("held")))
    sources = parts.groupBy("key").agg(F.sum("held").alias("source_size")).withColumn("name", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)))
    goals = targets(sources.select("name", "source_size"), weights, share, most).withColumn("key", F.coalesce(F.concat(F.lit("="), "name"), F.lit(""))).drop("name")

    def quotas(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        wanted = (group["target"] * group["held"] / group["source_size"].where(group["source_size"] > 0, 1)).tolist()
        blocks = (-(-group["held"] // block)).tolist()
        group["quota"] = apportioned(wanted, [most * b for b in blocks], round(sum(wanted) / block))
        return group

    plan = parts.join(goals, "key").groupBy("shard").applyInPandas(quotas, "key string, shard long, held long, source_size long, target double, quota long")
    plan = plan.withColumn("blocks", F.ceil(F.col("held") / block))
    plan = plan.withColumn("first", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "key", "shard"), F.col("blocks"))))
    layout = Window.partitionBy("key", "shard").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(layout), F.lit(0))).join(plan, ["key", "shard"])
    whole = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)
    end = F.col("first") + F.when(F.col("blocks") > 0, F.pmod("quota", "blocks")).otherwise(0)

    def piece(lo: Column, hi: Column) -> Column:
        """The part of a range of the layout that falls into the document."""
        return F.struct((F.greatest("at", lo) - F.col("at")).alias("from"), (F.least(F.col("at") + F.col("size"), hi) - F.col("at")).alias("to"))

    ranges = F.array(piece(F.col("first") * block, F.least(end * block, F.col("held"))), piece(F.lit(0).cast("long"), F.greatest(F.lit(0), (end - F.col("blocks")) * block)))
    pieces = F.filter(F.when(F.col("blocks") > 0, ranges).otherwise(F.slice(ranges, 1, 0)), lambda p: p["from"] < p["to"])
    rows = rows.withColumns({"whole": whole, "pieces": pieces})
    taken = F.col("whole") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"])
    return rows.select("row", F.struct("size", "source_size", "target", taken.alias("taken"), "whole", "pieces").alias("mix"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, mix_col: str = "_mix") -> DataFrame:
    """``docs``, all rows and columns, and a column ``mix_col``, in place of one of that name: what the mix takes of each.

    It is a struct of size (words), source_size, target (its source's words), taken (words, repeats counted), whole
    (how often the whole document is taken) and pieces (word ranges [from, to) taken once more). No document is taken
    over ``most`` times. A null source is a source of its own, the last; null and empty texts have no words and are never
    taken. Rows of equal id and text stand next to each other in the layout, in any order, unless they are so many that
    one shard would gather over a thousandth of all rows; then each has a place of its own. An empty table gives an empty
    one. Other columns may have any name. Each shard is a hashed share of about ``shard_rows`` rows, so that a source of
    any size is split over all shards; a source's shard is off its target by a block or so. The window and the join share
    one shuffle.
    """
    rows = _mixed(docs, id_col, text_col, source_col, block, shard_rows, seed, weights, share, most)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != mix_col], F.col("mix").alias(mix_col))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each as often as it is taken whole, and the words of its pieces."""
    rows = _mixed(docs, id_col, text_col, source_col, block, shard_rows, seed, weights, share, most)
    text = F.col("row")[text_col]
    found = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    piece = F.transform("mix.pieces", lambda p: F.when((p["from"] == 0) & (p["to"] == F.col("mix.size")), text).otherwise(F.array_join(F.slice(found, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), " ")))
    copies = F.concat(F.array_repeat(text, F.when(F.col("mix.size") > 0, F.col("mix.whole")).otherwise(0).cast("int")), piece)
    rows = rows.select("row", F.explode(copies).alias("copy"))
    return rows.select(*[(F.col("copy") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mixed(docs).select("doc_id", *[F.col(f"_mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")])
