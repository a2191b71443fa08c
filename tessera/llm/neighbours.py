"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are quantised to int8 with one scale each. A tile is the product of a block of queries and a block of
candidates: int8 products give each inner product up to a bound that follows from the quantisation errors,

    |q.c - q~.c~| <= |q - q~| |c~| + |q| |c - c~|,

and only pairs whose upper bound reaches the query's 20th best so far are computed again in double precision on the
original vectors. Each query keeps its best in a heap; the heaps of all tiles are merged at the end. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Rows of a block of queries, of a block of candidates, and of the candidates that one int8 product takes.
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 1024, 8192, 1024
#: Relative slack on top of the quantisation bound, for the rounding of the bound itself.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the restored vectors, and lengths of the errors, of the rows of x (none of them zero)."""
    # rows are first brought to a largest component of 1, so that no square over- or underflows
    scale = np.abs(x).max(axis=1) / 127
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    codes = np.rint(unit * 127).astype(np.int8)
    whole = codes.astype(np.float64)
    return codes, scale, scale * np.sqrt((whole**2).sum(axis=1)), scale * np.sqrt(((unit * 127 - whole) ** 2).sum(axis=1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int8 tile a @ b.T, exact: sums of up to 1040 products stay below 2**24, where float32 holds every integer; wider rows are summed in float64."""
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows in double precision, their terms added one after the other."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best_in(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, candidate_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of each query's k nearest among the candidates, itself left out."""
    order = np.argsort(candidate_ids, kind="stable")
    candidates, candidate_ids = candidates[order], candidate_ids[order]
    q8, q_scale, q_whole, q_error = quantised(queries)
    q_length = q_whole + q_error
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]  # (score, -id): the worst is at the top
    floor = np.full(len(queries), -np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(candidates), TILE):
            part, ids = candidates[at : at + TILE], candidate_ids[at : at + TILE]
            c8, c_scale, c_whole, c_error = quantised(part)
            near = product(q8, c8) * q_scale[:, None] * c_scale
            bound = q_error[:, None] * c_whole + q_length[:, None] * c_error
            upper = near + bound + SLACK * (q_length[:, None] * (c_whole + c_error))
            # the k-th largest lower bound of a first tile is a floor, too
            if not np.isfinite(floor).any() and len(part) > k:
                lower = near - bound - SLACK * (q_length[:, None] * (c_whole + c_error))
                first = np.partition(lower, -k - 1, axis=1)[:, -k - 1]  # one more, as a query may meet itself
            else:
                first = floor
            keep = ~(upper < np.maximum(floor, first)[:, None]) & (ids != query_ids[:, None])
            a, b = np.nonzero(keep)
            for lo in range(0, len(a), 1 << 16):
                i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                scores = inner(queries[i], part[j])
                better = scores > floor[i]  # ids come in ascending order: an equal score later on never displaces one
                for q, s, c in zip(i[better].tolist(), scores[better].tolist(), ids[j[better]].tolist()):
                    heap = heaps[q]
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -c))
                    elif (s, -c) > heap[0]:
                        heapq.heapreplace(heap, (s, -c))
                for q in np.unique(i).tolist():
                    if len(heaps[q]) == k:
                        floor[q] = heaps[q][0][0]
    n = [len(h) for h in heaps]
    flat = [x for h in heaps for x in h]
    return np.repeat(query_ids, n), np.array([-c for _, c in flat], np.int64), np.array([s for s, _ in flat], np.float64)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id long and vector array<double> of the rows that take part: an id, a vector that is not null, empty or zero, and finite components only."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("id is not null and vector is not null").where(whole & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id ``every`` divides, its k nearest other rows by inner product: query_id, rank int from 1, id_col, score.

    Ties go to the smaller id. Vectors are compared with those of their own length only. Rows without an id, and vectors
    that are null, empty, zero or hold a null or non-finite component take no part. Repeated rows count once; different
    vectors of one id are candidates and queries of that id each, their results ranked together. All vectors are dealt
    into blocks of bounded size by a hash of id and vector, so that neither copies nor hot values gather; a block pair is
    one task's work. The work is queries times candidates by definition of an exact search; the shuffle is each side once
    for each block of the other. An empty table gives an empty one.
    """
    rows = cut(usable(vectors, id_col, vector_col).dropDuplicates(["id", "vector"]).withColumn("size", F.size("vector")))
    n, q = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    parts, rounds = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-q // QUERY_BLOCK))
    spread = F.xxhash64("id", "vector")
    queries = rows.where(F.col("id") % every == 0).withColumn("q", F.pmod(spread, F.lit(rounds))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    candidates = rows.withColumn("c", F.pmod(spread, F.lit(parts))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    key = [F.col("size"), F.col("q").cast("long"), F.col("c").cast("long")]

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})
        got = best_in(np.stack(left["vector"].to_list()), left["id"].to_numpy(), np.stack(right["vector"].to_list()), right["id"].to_numpy(), k)
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), got)))

    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(tile, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose vec_id 20 divides: query_id, rank, vec_id, score."""
    return nearest(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
