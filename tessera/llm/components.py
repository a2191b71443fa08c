"""Connected components of a link table by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _both_ways(links: DataFrame) -> DataFrame:
    # one pass over the links, not a union of two reads
    return links.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")


def _large_star(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = _both_ways(links)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, to the least of them. Links come with u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _united(links: DataFrame) -> DataFrame:
    """The links of each partition as links (u > v) to the least node that they reach within it: at most as many as before, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = y = up.get(y, y)
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        for at in range(0, len(nodes), 1 << 16):
            part = nodes[at : at + (1 << 16)]
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array(list(map(root, part)), pa.int64())], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """The least node that each linked node can reach: columns node, root. Roots and nodes without links are absent.

    ``links`` has two integer columns; nulls and links of a node to itself are ignored, repeated links do no
    harm, and an empty table gives an empty one. Each round is a pair of star operations, which flatten every tree to its
    root in a number of rounds that is logarithmic in the longest path; the links stay at most as many as before. A hot
    node costs no more than its links: minima are taken map-side first, and the joins are plain equi-joins whose hot
    partitions Spark's adaptive skew handling can split.
    """
    links = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    # what each partition can unite by itself saves rounds; a partition's links, two numbers each, are held as a dict
    links = cut(_united(links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))).distinct())
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(most_rounds):
        links = cut(_united(_small_star(_large_star(links)).distinct()))
        # at the fixed point each node has one link, to its root: the multiset of links no longer changes
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")
