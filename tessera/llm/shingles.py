"""Near duplicates of a given Jaccard similarity: the SimHash index, and what bits alone lose.

No limit on differing SimHash bits gives right results at a similarity of 0.8: a low one loses pairs at the threshold, which
differ in 4 to 14 bits, and a high one links others and makes the index search everything. So the Gray-order index finds
the pairs within ``limit`` bits, the sets of shingles decide each of them, and a second search completes the links: two
sets with a similarity of at least ``least`` share one of their first elements, under any one order of all elements: of a
set of n the first n - ceil(least * n) + 1 (prefix filter). The order is that of the shingles' hashes with the common ones
last, by their count, which bears on the work only. Sets that share a first element and are not linked yet are compared:
each first with the set that has the fewest elements before the shared one, then those that still are not in one component
with one another, if enough elements follow the shared one in both.

Before its texts are read a pair passes a filter that loses nothing: a bitmap of parities, two to four bits an element.
Each element flips one bit, so that two bitmaps, the larger folded to the size of the smaller, differ in at most as many
bits as the sets in elements.
"""

from __future__ import annotations

from hashlib import blake2b
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, cut, join_hot, map_batches, shared_path, small_batches
from tessera.llm.components import components
from tessera.llm.simhash import first_of_each, majority, near_prints

#: Sets from which on a first element is moved to the end of the order, if it is among the ``LATE`` most common.
COMMON, LATE = 8, 1 << 17
#: Sets of one element up to which they are joined with each other, and that a task holds against each other at a time beyond.
MANY, BLOCK = 64, 512
#: Pairs that share one copy of a text when they are compared.
PAIRS = 256


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes, as fingerprint() does
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n))


def parities(x: np.ndarray) -> bytes:
    """A bitmap of a set of hashes: bit i is the parity of the number of elements that leave i modulo the size, a power of two."""
    size = max(64, 1 << (2 * len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def perhaps(a: bytes, n: int, b: bytes, m: int, least: float) -> bool:
    """False only if sets of n and m elements with these bitmaps have a similarity below ``least``."""
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    apart = np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum(dtype=np.int64)
    return bool(apart <= (n + m) * (1 - least) / (1 + least) + 1e-9)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, common: list[tuple[int, int]]) -> DataFrame:
    """id_col, text_hash, s (a digest of the set), n (its size), fp (its SimHash), bits (its parities) and its first elements of every row. ``common``: elements that come late, with their counts."""
    late, count = np.array([k for k, _ in common], np.int64).view(np.uint64), np.array([c for _, c in common], np.int64)
    order = np.argsort(late)
    late, count = late[order], count[order]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s, n, fp, bits, firsts = [], [], [], [], []
            for t in batch.column(2):
                x = shingles(t.as_py(), size)
                s.append(int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                n.append(len(x))
                fp.append(majority(x))
                bits.append(parities(x))
                if len(late):
                    at = np.minimum(np.searchsorted(late, x), len(late) - 1)
                    weight = np.where(late[at] == x, count[at], 0)
                    x = x[np.argsort(weight, kind="stable")]
                firsts.append(x[: len(x) - ceil(least * len(x) - 1e-9) + 1].view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            return pa.record_batch(columns, names=["id", "text_hash", "s", "n", "fp", "bits", "firsts"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(col(id_col), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col)), make, f"id {kind}, text_hash long, s long, n int, fp long, bits binary, firsts array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, least: float) -> DataFrame:
    """The distinct pairs (u, v) of similar sets. Texts are read of pairs only that the parities leave."""
    spark = docs.sparkSession

    @F.arrow_udf(T.BooleanType())
    def may(n: pa.Array, a: pa.Array, m: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([perhaps(x.as_py(), i, y.as_py(), j, least) for i, x, j, y in zip(n.to_pylist(), a, m.to_pylist(), b)], pa.bool_())

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict[int, np.ndarray] = {}
            keep = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if u not in known:
                    known = {u: shingles(a.as_py(), size)}  # rows of one u mostly come together
                keep.append(similar(known[u], shingles(b.as_py(), size), least))
            return pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

        return step

    of_size = F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9
    both = pairs.join(sets.select(F.col("s").alias("u"), "n", F.col("bits").alias("a")), "u").join(sets.select(F.col("s").alias("v"), F.col("n").alias("m"), F.col("bits").alias("b")), "v")
    left = _written(both.where(of_size).where(may("n", "a", "m", "b")).select("u", "v").distinct(), "pairs")
    rows = left.select(F.explode(F.array("u", "v")).alias("s")).distinct().join(sets, "s").select("s", F.coalesce("row.id", F.lit(0).cast(sets.schema["row"].dataType["id"].dataType)).alias("id"), "row.no_id", "row.text_hash")
    rows = _written(rows, "rows")
    i = col(id_col)
    own = docs.select(F.coalesce(i, F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"), i.isNull().alias("no_id"), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col).cast("string").alias("text"))
    texts = cut(own.join(rows, ["id", "no_id", "text_hash"]).select("s", "text").dropDuplicates(["s"]))
    # a text that many pairs share is repeated for every PAIRS of them, so that no task meets all
    parts = left.groupBy("u").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    of_u = texts.join(parts, texts["s"] == parts["u"]).select("u", F.col("text").alias("a"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = left.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
    of_v = dealt.join(texts.select(F.col("s").alias("v"), F.col("text").alias("b")), "v")
    return cut(map_batches(of_v.join(of_u, ["u", "part"]).select("u", "v", "a", "b"), make, "u long, v long"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: unlike a checkpoint it has a known size, by which Spark decides whether a join can broadcast it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _others(of: DataFrame, held: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of sets that share an element, are in different components, and may be similar: where both have enough elements from the shared one on, which the first one that two similar sets share grants.

    Elements of few sets are joined with themselves. Those of many sets are dealt in pairs of blocks, and a task holds the
    parities of two blocks against each other, so that only what they leave is emitted, and that below the first element
    that two sets share only: ``held`` has all of a set that are shared.
    """
    share = least / (1 + least)
    size = of.groupBy("k").agg(F.count("*").alias("many"))
    few = of.join(size.where(F.col("many") <= MANY), "k")
    x, y = few.alias("x"), few.alias("y")
    apart = (F.col("x.s") < F.col("y.s")) & (F.col("x.root") != F.col("y.root"))
    enough = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) >= (F.col("x.n") + F.col("y.n")) * share - 1e-9
    found = x.join(y, (F.col("x.k") == F.col("y.k")) & apart & enough).select(F.col("x.s").alias("u"), F.col("y.s").alias("v"))
    rows = of.join(size.where(F.col("many") > MANY), "k").join(sets.select("s", "bits"), "s")
    shared = held.join(rows.select("s").distinct(), "s", "left_semi").groupBy("s").agg(F.collect_list(F.struct("i", "k")).alias("shared"))
    rows = rows.join(shared, "s").withColumn("before", F.transform(F.filter("shared", lambda x: x["i"] < F.col("i")), lambda x: x["k"])).withColumn("blocks", F.ceil(F.col("many") / BLOCK))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("s"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("k", "s", "n", "i", "root", "bits", "before", F.least("b", "j").alias("p"), F.greatest("b", "j").alias("q"), (F.col("b") > F.col("j")).alias("second"))

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        first, second = group[~group["second"]], group[group["second"]]
        if group["p"].iloc[0] == group["q"].iloc[0]:
            second = first
        out = [np.empty((0, 2), np.int64)]
        for m, left in first.groupby(first["bits"].map(len)):
            for k, right in second.groupby(second["bits"].map(len)):
                size = min(m, k)
                a, b = (_folded(side["bits"].tolist(), size) for side in (left, right))
                s, n, i, root = ((left[c].to_numpy()[:, None], right[c].to_numpy()[None, :]) for c in ("s", "n", "i", "root"))
                both = n[0] + n[1]
                keep = (root[0] != root[1]) & (np.minimum(n[0] - i[0], n[1] - i[1]) >= both * share - 1e-9)
                at, to = np.nonzero(keep)
                for part in range(0, len(at), 1 << 14):
                    p, q = at[part : part + (1 << 14)], to[part : part + (1 << 14)]
                    near = np.bitwise_count(a[p] ^ b[q]).sum(axis=1, dtype=np.int64) <= both[p, q] * (1 - least) / (1 + least) + 1e-9
                    p, q = p[near], q[near]
                    before = [{x: set(side["before"].iloc[x].tolist()) for x in set(of.tolist())} for side, of in ((left, p), (right, q))]
                    first_shared = np.array([before[0][x].isdisjoint(before[1][y]) for x, y in zip(p.tolist(), q.tolist())], bool)
                    u, v = s[0][p[first_shared], 0], s[1][0, q[first_shared]]
                    out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])

    return found.unionByName(rows.groupBy("k", "p", "q").applyInPandas(compared, "u long, v long")).distinct()


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one size, as rows of 64-bit words, folded to ``size`` bytes."""
    rows = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, size // 8)
    return np.bitwise_xor.reduce(rows, axis=1)


def _mixed(held: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """k, s, n, i and root of the sets below those elements whose sets are not all in one component."""
    of = held.join(roots, held["s"] == roots["node"], "left").select("k", "s", "i", F.coalesce("root", "s").alias("root"))
    mixed = of.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("k")
    return cut(of.join(mixed, "k", "left_semi").join(sets.select("s", "n"), "s"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, limit: int = 3) -> DataFrame:
    """One row per document: id, text_hash, root (names the component that links of a Jaccard similarity of at least ``least`` make).

    Words are in lower case (A-Z). Null and texts without words make one component. Equal sets count once in the search.
    ``limit`` is that of the SimHash index and bears on the work only. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    firsts = _sets(docs, id_col, text_col, size, least, []).select(F.explode("firsts").alias("k"))
    most = firsts.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON).orderBy(F.col("c").desc(), "k").limit(LATE)
    marked = cut(_sets(docs, id_col, text_col, size, least, [(r.k, r.c) for r in most.collect()]))
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    sets = cut(marked.groupBy("s").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.min(row).alias("row"), F.count("*").alias("copies")))

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, sets, docs, id_col, text_col, size, least)

    # pairs within a few bits: the index finds fingerprints, each stands for the least of its sets
    prints = cut(sets.groupBy("fp").agg(F.min("s").alias("u"), F.count("*").alias("c")))
    one = join_hot(sets.select("fp", F.col("s").alias("v")), prints, "fp", "c").where("u <> v").select("u", "v")
    near = near_prints(prints, limit)
    two = near.join(prints.select(F.col("fp").alias("u"), F.col("u").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("u").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = verified(one.unionByName(two))
    # sets that share a first element: with the least of them, then with each other where still apart
    elements = marked.select("s", F.posexplode("firsts").alias("i", "k"))
    shared = cut(elements.groupBy("k").agg(F.count("*").alias("c"), F.min("s").alias("first"), F.max("s").alias("last")).where("first < last").select("k", "c"))
    held = cut(join_hot(elements, shared, "k", "c").select("k", "s", "i").distinct())
    # the set with the fewest rarer elements before the shared one is most like the others
    centre = cut(held.groupBy("k").agg(F.min(F.struct("i", "s")).alias("least"), F.count("*").alias("c")).select("k", "c", F.col("least.s").alias("u")))
    firsts = join_hot(held, centre, "k", "c").where("s <> u").select(F.least("u", "s").alias("u"), F.greatest("u", "s").alias("v")).distinct()
    links = links.unionByName(verified(firsts.join(links, ["u", "v"], "left_anti")))
    of = _mixed(held, components(links), sets)
    links = links.unionByName(verified(_others(of, held, sets, least)))
    roots = components(links)
    named = cut(sets.join(roots, sets["s"] == roots["node"], "left").select("s", "copies", F.coalesce("root", "s").alias("root")))
    return join_hot(marked.select("id", "text_hash", "s"), named, "s", "copies").select("id", "text_hash", "root")
