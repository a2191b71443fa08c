"""Document fingerprints by Order MinHash.

The k-mers of a text are numbered by occurrence, so that repeats are different elements. For each component of the
signature the ``size`` least elements under that component's own random order are selected, put back in the order in
which they stand in the text, and hashed as a tuple: two texts agree in a component if the same k-mers were selected in
the same order, which an edit that moves text breaks as one that changes it does.

The random orders come from rounds. In each round every element falls into one component at random; a component ranks its
elements by round, then by hash. So one pass over a long text serves all components, and a short one takes more rounds;
the order of each component is the same for texts of every length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

KMER, COMPONENTS, TUPLE = 12, 128, 2
_ROUNDS, _BITS = 64, 7  # COMPONENTS is 2**_BITS
_U = np.uint64
_P = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(33))
    x *= _P[4]
    x ^= x >> _U(29)
    x *= _P[5]
    x ^= x >> _U(32)
    return x


def kmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each k-mer with its occurrence number. A shorter text is one k-mer, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    if n < KMER:
        h = _U(n)
        with np.errstate(over="ignore"):
            for p in points:
                h = (h + p + _U(1)) * _P[0]
        return _mix(np.array([h] if n else [], np.uint64)), np.zeros(min(n, 1), np.int64)
    two = points[:-1] * _P[0] + points[1:]
    four = two[:-2] * _P[1] + two[2:]
    eight = four[:-4] * _P[2] + four[4:]
    h = _mix(eight[: n - 11] * _P[3] + four[8:])
    m = len(h)
    if m < 1 << 24:  # hash and place in one word: a sort by value is a sort by both
        s = np.sort((h & ~_U(0xFFFFFF)) | np.arange(m, dtype=np.uint64))
        place, h = (s & _U(0xFFFFFF)).astype(np.int64), s >> _U(24)
    else:
        place = np.argsort(h >> _U(24), kind="stable")
        h = h[place] >> _U(24)
    new = np.empty(m, bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    if new.all():
        return _mix(h), place
    index = np.arange(m)
    number = index - np.maximum.accumulate(np.where(new, index, 0))
    return _mix(h + number.astype(np.uint64) * _P[0]), place


def _least(e: np.ndarray, rounds: int, share: float) -> np.ndarray:
    """The ``TUPLE`` first elements of each component after so many rounds, -1 where there are fewer. share: the part of the hash range to look at."""
    n = len(e)
    if rounds == 1:
        x = _mix(e)
        low = x << _U(_BITS)  # the hash within the component
        which = np.flatnonzero(low <= _U(int(share * (2**64 - 1)))) if share < 1 else np.arange(n)
        key = x[which]
        key = (key >> _U(64 - _BITS) << _U(64 - _BITS)) | (key & _U((1 << 64 - _BITS) - 1)) >> _U(6)
    else:
        x = _mix(e[None, :] + (np.arange(rounds, dtype=np.uint64) * _P[1])[:, None])
        number = np.repeat(np.arange(rounds, dtype=np.uint64), n)
        x = x.ravel()
        key = (x >> _U(64 - _BITS) << _U(64 - _BITS)) | number << _U(64 - _BITS - 6) | (x & _U((1 << 64 - _BITS) - 1)) >> _U(6)
        which = np.tile(np.arange(n), rounds)
    order = np.argsort(key)
    element, component = which[order], (key[order] >> _U(64 - _BITS)).astype(np.int64)
    found = np.full((COMPONENTS, TUPLE), -1)
    for t in range(TUPLE):
        if not len(component):
            break
        first = np.flatnonzero(np.concatenate(([True], component[1:] != component[:-1])))
        found[component[first], t] = element[first]
        keep = element != found[component, t]
        element, component = element[keep], component[keep]
    return found


def signature(text: str | None) -> np.ndarray:
    """COMPONENTS hashes of 24 bits. Null and empty texts have zeros only."""
    e, place = kmers(text or "")
    n = len(e)
    if not n:
        return np.zeros(COMPONENTS, np.uint32)
    want = min(TUPLE, n)
    rounds = min(_ROUNDS, -(-20 * COMPONENTS // n))
    found = _least(e, rounds, 16 * COMPONENTS / n if n >= 20 * COMPONENTS else 1.0)
    while (found[:, want - 1] < 0).any() and rounds < _ROUNDS:
        if rounds == 1 and n >= 20 * COMPONENTS:
            found = _least(e, 1, 1.0)  # a component had too few below the share
            if (found[:, want - 1] >= 0).all():
                break
        rounds = min(_ROUNDS, 4 * rounds)
        found = _least(e, rounds, 1.0)
    for c in np.flatnonzero(found[:, want - 1] < 0).tolist():  # very short texts: a last round, in which all fall into each
        chosen = [x for x in found[c].tolist() if x >= 0]
        chosen += [x for x in np.argsort(_mix(e + _U((c + 1000) * int(_P[2]) % 2**64))).tolist() if x not in chosen]
        found[c, :want] = chosen[:want]
    found = found[:, :want]
    found = np.take_along_axis(found, np.argsort(place[found], axis=1), axis=1)  # back in the order of the text
    h = np.full(COMPONENTS, _U(want))
    for t in range(want):
        h = _mix(h * _P[0] + e[found[:, t]])
    return (h >> _U(40)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of components in which two signatures agree."""
    return float((a == b).mean())


def shown(s: np.ndarray) -> str:
    """A signature as text: six hex digits a component."""
    return s.astype(">u4").tobytes().hex(" ", 4).replace(" 00", "")[2:]


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in ranges of descending ids, each range with the row that follows it: columns part, extra (it only follows), id, hash, text.

    The ranges' bounds are quantiles; they and the ranges' first ids, one a partition, are all that the driver holds.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    bounds = ids.agg(F.percentile_approx("id", [(k + 1) / parts for k in range(parts - 1)] or [0.5], max(10_000, 20 * parts))).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))

    def part_of(column: pa.Array) -> np.ndarray:
        null = column.is_null().to_numpy(zero_copy_only=False)
        out = len(bounds) - np.searchsorted(bounds, column.fill_null(0).to_numpy(), side="left")
        return np.where(null, len(bounds), out)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int | None] = {}
        for batch in batches:
            part = part_of(batch.column(0))
            values = batch.column(0).to_numpy(zero_copy_only=False)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for p in np.unique(part).tolist():
                here = values[(part == p) & ~null]
                top = int(here.max()) if len(here) else None
                if p not in seen or seen[p] is None or (top is not None and top > seen[p]):
                    seen[p] = top
        yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["part", "first"])

    heads = {r.part: r.top for r in ids.mapInArrow(firsts, "part int, first long").groupBy("part").agg(F.max("first").alias("top")).collect()}
    order = sorted(heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}  # cyclic: the first range follows the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = part_of(batch.column(0))
            i = batch.column(0).to_pylist()
            head = np.array([k for k, p in enumerate(part.tolist()) if i[k] == heads[p]], np.int64)
            both = pa.array(np.concatenate((np.arange(len(i)), head)))
            to = np.concatenate((part, [before[p] for p in part[head].tolist()])).astype(np.int32)
            extra = np.concatenate((np.zeros(len(i), bool), np.ones(len(head), bool)))
            yield pa.record_batch([pa.array(to), pa.array(extra), batch.column(0).take(both), batch.column(1).take(both)], names=["part", "extra", "id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.mapInArrow(deal, "part int, extra boolean, id long, text string").withColumn("hash", F.xxhash64("text"))
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "extra", F.col("id").desc_nulls_last(), "hash")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, and their likeness.

    Returns id_col long, n_chars long, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The text
    that follows is that of the next lower id (null ids come last, rows of one id in the order of their texts' hashes),
    and after the last row that of the first. Null texts count as empty. Each text is shuffled once, whatever its length;
    an only row follows itself; an empty table gives an empty one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose follower is still to come: part, id, text, signature
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for part, extra, i, t in zip(*[batch.column(k) for k in range(4)]):
                part, extra, i, t = part.as_py(), extra.as_py(), i.as_py(), t.as_py()
                if extra and (held is None or held[0] != part):
                    continue  # rows after the one that follows, as where an id is repeated
                own = signature(t)
                if held is not None and held[0] == part:
                    _, j, text, s = held
                    new = edited(text, t)
                    other = signature(new) if new != text else s
                    for column, x in zip(rows, (j, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), shown(s), shown(other), likeness(s, other), likeness(s, own))):
                        column.append(x)
                held = None if extra else (part, i, t, own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs, id_col, text_col).select("part", "extra", "id", "text").mapInArrow(run, schema)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints, edited texts' digests and likenesses."""
    return fingerprints(table(spark, sf_dir, "documents"))
