"""Every query of the engine by name, its SQL, and the flagship."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES, id_list_output


#: Columns that both engines round to six digits, as sums and logarithms of doubles differ in the last ones.
ROUNDED = {
    "match_cardinality": ("mean", "std", "p25", "median", "p75", "singletons"),
    "exclusivity": ("share",),
    "missing_partition": ("missing",),
    "prefilter_recall": ("blocking_recall", "prefilter_recall", "loss"),
    "postal_house_coverage": ("postal", "house"),
    "script_shares": ("share",),
    "name_duplication": ("share",),
    "source_asymmetry": ("mean", "p25", "p50", "p75"),
    "matches_by_source": ("share",),
    "token_idf": ("idf",),
    "blocking_recall": ("recall",),
}


def _rounded(f: Callable[[SparkSession, str], DataFrame], columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.round(c, 6) for c in columns})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _rounded(f, ROUNDED[name]) if name in ROUNDED else f for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    replace = lambda name: ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED[name])
    return {name: f"SELECT * REPLACE ({replace(name)}) FROM (\n{sql}\n)" if name in ROUNDED else sql for name, sql in ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are blocked, scored, decided one to one, and written as one id list an entity."""
    return id_list_output(spark, sf_dir)
