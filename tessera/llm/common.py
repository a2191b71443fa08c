"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that ``join_hot`` broadcasts: a fixed bound, whatever the input.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, or that its context has; without either, one in the warehouse, which all nodes share, too."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-checkpoints")
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a written table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch that are worked on at a time: what a step makes in Python is bounded by these rows' texts.
STEP_ROWS = 512


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``make()(batch)`` to the rows of each partition, ``STEP_ROWS`` at a time.

    ``make`` runs once a task, so that it can hold state such as caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                yield step(batch.slice(at, STEP_ROWS))

    return df.mapInArrow(run, schema)


#: Bytes of an Arrow batch, beyond which a batch holds one row only.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch, so that few long texts are in memory at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not BATCH_BYTES >= int(str(spark.conf.get(name)).rstrip("bB")) > 0:
        spark.conf.set(name, str(BATCH_BYTES))


def col(name: str) -> Column:
    """The column of exactly that name."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column, in any case of letters, has that name."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        n = "_" + n
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: Size of the sketch that finds heavy values: its counts are off by at most 3.5 / TRACKED of all.
TRACKED = 8192


def heavy(column: str) -> Column:
    """Aggregates the ``HOT_KEYS`` most frequent values (item, count) of a column by a sketch of bounded size, which misses none that over a thousandth of the rows have."""
    return F.expr(f"approx_top_k({column}, {HOT_KEYS}, {TRACKED})")


def heavy_values(rows: DataFrame, column: str) -> list:
    """The values of a column that over a thousandth of the rows have, and perhaps some that a little fewer have: ``HOT_KEYS`` at most."""
    n, top = rows.agg(F.count("*"), heavy(column)).first()
    return [x["item"] for x in top or [] if x["count"] > max(1, n // HOT_KEYS)]


def spread(hashed: Column, rows: DataFrame, column: str) -> Column:
    """``hashed``, a hash of rows that equal rows share and that ``rows`` has as ``column``, made different for each row of those that repeat so often that one value would gather over a thousandth of all rows.

    Which of the equal rows gets which hash follows from its place in the input; as they are equal, results over the same
    input agree.
    """
    often = heavy_values(rows, column)
    if not often:
        return hashed
    return F.when(hashed.isin(often), F.xxhash64(hashed, F.monotonically_increasing_id())).otherwise(hashed)


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (one row a key) on ``key``, one column or several, safe for hot keys.

    ``weight`` is the column of ``right`` that counts the key's rows in ``left``. The ``HOT_KEYS`` heaviest keys, a fixed
    number, are joined by broadcast; each other key has at most 1/HOT_KEYS of the rows, so that a shuffled join is even.
    ``right`` should be cut or cheap, as it is read more than once. ``how``: inner or left.
    """
    key = [key] if isinstance(key, str) else key
    hot = cut(right.orderBy(F.col(weight).desc(), *key).limit(HOT_KEYS))
    keys = F.broadcast(hot.select(*key))
    warm = left.join(F.broadcast(hot), key, "inner")
    cold = left.join(keys, key, "left_anti").join(right.join(keys, key, "left_anti"), key, how)
    return warm.unionByName(cold)
