"""The decision layer: which scored pairs are matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR, SINGLETON, CAP = 0.50, 0.70, 12


def one_to_one(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each candidate keeps its best entity (of each country, if given); ties go to the lower entity id. An entity may keep many candidates."""
    w = Window.partitionBy(*by, "cand_id").orderBy(F.col("p_match").desc(), "s1_id")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def decide(scored: DataFrame, pair: float | str = PAIR, singleton: float | str = SINGLETON, margin: float | None = None, cap: int = CAP, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs at or above ``pair``, one entity a candidate, ``cap`` an entity, and none where the best stays below ``singleton``.

    Thresholds are numbers or columns. ``margin``, measured before the one-to-one step, drops pairs further below their
    candidate's best; off by default.
    """
    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    kept = scored.where(F.col("p_match") >= value(pair))
    if margin is not None:
        best = F.max("p_match").over(Window.partitionBy(*by, "cand_id"))
        kept = kept.withColumn("_best", best).where(F.col("_best") - F.col("p_match") <= margin).drop("_best")
    kept = one_to_one(kept, by)
    w = Window.partitionBy("s1_id")
    kept = kept.withColumns({"_r": F.row_number().over(w.orderBy(F.col("p_match").desc(), "cand_id"))}).where(F.col("_r") <= cap)
    return kept.withColumn("_top", F.max("p_match").over(w)).where(F.col("_top") >= value(singleton)).drop("_r", "_top")


def decide_by_country(scored: DataFrame, thresholds: DataFrame, default: tuple[float, float] = (PAIR, SINGLETON)) -> DataFrame:
    """``decide`` with thresholds by country (country, pair, singleton; one row a country), the default elsewhere."""
    rows = scored.join(thresholds.select("country", F.col("pair").alias("_pair"), F.col("singleton").alias("_singleton")), "country", "left")
    rows = rows.withColumns({"_pair": F.coalesce("_pair", F.lit(default[0])), "_singleton": F.coalesce("_singleton", F.lit(default[1]))})
    return decide(rows, "_pair", "_singleton", by=("country",)).drop("_pair", "_singleton")


def prefix_size(q: list[float], extra: float, most: int = 12) -> int:
    """How many of the candidates, best first, maximise the expected F0.5, if they are true independently with q and a Poisson number of true ones (``extra``) was never found.

    E(0) is the chance of no true one at all; E(k) = sum over a true ones in the prefix and b elsewhere of
    P(a) P(b) 1.25 a / (k + 0.25 (a + b)). Equal expectations go to the smaller prefix.
    """
    q = q[:most]
    missed = [np.exp(-extra)]
    for i in range(1, most):
        missed.append(missed[-1] * extra / i)
    chances = lambda ps: np.array([1.0]) if not len(ps) else np.convolve(chances(ps[:-1]), [1 - ps[-1], ps[-1]])
    best, expected = 0, float(np.prod([1 - x for x in q]) * missed[0])
    for k in range(1, len(q) + 1):
        a, b = chances(q[:k]), np.convolve(chances(q[k:]), missed)
        i, j = np.arange(len(a))[:, None], np.arange(len(b))[None, :]
        value = float((a[:, None] * b[None, :] * 1.25 * i / (k + 0.25 * (i + j))).sum())
        if value > expected + 1e-12:
            best, expected = k, value
    return best


def decode(scored: DataFrame, extra: float | str = 0.0, most: int = 12, cap: float = 1e-5) -> DataFrame:
    """The pairs of each entity's best prefix by expected F0.5. p_match is a calibrated chance; an entity has ``most`` candidates at most. Pairs without a score do not count.

    ``extra``: true pairs of an entity that are no candidates, on average; a name is that of a column, one value an entity.
    """
    scored = scored.where("p_match is not null")
    w = Window.partitionBy("s1_id").orderBy(F.col("p_match").desc(), "cand_id")
    top = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    lists = top.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("_r", "cand_id", "p_match"))).alias("l"), F.max(F.col(extra) if isinstance(extra, str) else F.lit(extra)).cast("double").alias("_extra"))

    @F.pandas_udf("int")
    def size(q: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([prefix_size([min(max(v, cap), 1 - cap) for v in x], e, most) for x, e in zip(q, more)])

    return lists.withColumn("k", size(F.transform("l", lambda x: x["p_match"]), F.coalesce("_extra", F.lit(0.0)))).select("s1_id", F.posexplode("l").alias("i", "x"), "k").where("i < k").select("s1_id", F.col("x.cand_id").alias("cand_id"), F.col("x.p_match").alias("p_match"))
