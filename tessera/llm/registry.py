"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, counts, licenses, minhash, mixing, neighbours, quality, sharding, simhash, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_neighbours": neighbours.op2_neighbours,
        "op3_counts": counts.op3_counts,
        "op4_licenses": licenses.op4_licenses,
        "op5_sharding": sharding.op5_sharding,
        "op6_mixing": mixing.op6_mixing,
        "op7_simhash": simhash.op7_simhash,
        "op8_quality": quality.op8_quality,
        "op9_bpe": bpe.op9_bpe,
        "op10_substrings": substrings.op10_substrings,
    }


def oracle_sql() -> dict[str, str]:
    """For the others SQL has no XXH64, CRC-32, BPE or boosted trees; tests hold them against brute-force versions."""
    return {"op2_neighbours": neighbours.OP2_SQL, "op4_licenses": licenses.oracle_sql()}
