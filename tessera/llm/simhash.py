"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints whose bits differ in few places are found through trees of bit patterns. The upper nodes are shared masked
patterns: the 64 bits are cut into ``limit + 2`` blocks, and two fingerprints within ``limit`` bits agree on at least two
of these blocks, so each pair of blocks with its value is a node, and nodes are what the cluster deals out. Below such a
node its fingerprints are sorted by Gray rank, so that neighbours share long patterns; runs of them make leaves, and levels
of inner nodes hold the bits that all fingerprints below share. A search goes down from the upper node of a fingerprint
and adds up the differing bits, each node counting only the bits that its parent does not fix, and leaves a whole subtree
once the sum exceeds the limit. All trees of a task are searched side by side, those of two fingerprints like those of
thousands; a fingerprint that is alone in a node has nothing to find there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, cut, fresh, join_hot, map_batches, shared_path, small_batches, table
from tessera.llm.components import components

#: Fingerprints below an upper node from which on it is split by further patterns; in a leaf; nodes below an inner node.
SPLIT_OVER, LEAF, FAN = 1 << 16, 8, 8
#: Fingerprints that are searched for at a time, and those whose trees are held at a time unless one node has more.
QUERIES, HELD = 1 << 10, 1 << 15
_U = np.uint64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the XXH64 of its shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(words) - shingle + 1, xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of the hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bits are unpacked for so many at a time
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> _U(s)
    return x


def unite(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the groups of a[i] and b[i] for each i. ``group`` holds the least place of each place's group, before and after."""
    while True:
        of_a, of_b = group[a], group[b]
        if (of_a == of_b).all():
            return
        least = np.minimum(of_a, of_b)
        np.minimum.at(group, of_a, least)
        np.minimum.at(group, of_b, least)
        while not ((up := group[group]) == group).all():
            group[:] = up


class GrayIndex:
    """Trees over distinct 64-bit words, one for each upper node, given in any order.

    ``upper`` says the upper node of each word; without it all words are below one.
    """

    def __init__(self, words: np.ndarray, upper: np.ndarray | None = None, leaf: int = LEAF, fan: int = FAN):
        upper = np.zeros(len(words), np.int64) if upper is None else upper
        self.order = np.lexsort((gray_rank(words), upper))
        self.words, upper = words[self.order], upper[self.order]
        #: From the leaves up: the first word or node below each node, and at the end how many there are below all.
        self.below: list[np.ndarray] = []
        tree, size, levels = upper, leaf, []
        ones, any_ = self.words, self.words
        while True:
            first = np.concatenate(([True], tree[1:] != tree[:-1]))
            place = np.arange(len(tree)) - np.maximum.accumulate(np.where(first, np.arange(len(tree)), 0))
            cuts = np.flatnonzero(place % size == 0)
            ones, any_, width = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(any_, cuts), len(tree)
            self.below.append(np.append(cuts, width))
            levels.append((ones, ~(ones ^ any_)))
            tree, size = tree[cuts], fan
            if (tree[1:] != tree[:-1]).all():
                break
        #: The tree of each word: its root's place among the roots.
        self.root = np.repeat(np.arange(len(tree)), np.diff(np.flatnonzero(np.concatenate(([True], upper[1:] != upper[:-1], [True])))))
        #: From the leaves up: the bits that all words below a node share, and their mask without what the parent's mask holds.
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        for k, (ones, mask) in enumerate(levels):
            if k + 1 < len(levels):
                mask = mask & ~np.repeat(levels[k + 1][1], np.diff(self.below[k + 1]))
            self.nodes.append((ones, mask))
        self.compared = 0  # words that leaves held against a query

    def _children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words or nodes there are below each of the nodes, and all of them."""
        first, end = self.below[level][node], self.below[level][node + 1]
        n = end - first
        return n, np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)

    def link(self, limit: int) -> np.ndarray:
        """For each word, in the order given, the place of its group's first word: the groups are chains of words within ``limit`` bits below one upper node."""
        n, words = len(self.words), self.words
        group = np.arange(n)
        for at in range(0, n, QUERIES):
            who = np.arange(at, min(n, at + QUERIES))
            # subtrees whose words all are in one group already: a query of that group need not look there
            uniform, low, high = [], group, group
            for below in self.below:
                low, high = np.minimum.reduceat(low, below[:-1]), np.maximum.reduceat(high, below[:-1])
                uniform.append(np.where(low == high, low, -1))
            node, so_far = self.root[who], np.zeros(len(who), np.int64)
            for level in range(len(self.nodes) - 1, -1, -1):
                ones, own = self.nodes[level]
                so_far = so_far + np.bitwise_count((words[who] ^ ones[node]) & own[node])
                keep = (so_far <= limit) & (uniform[level][node] != group[who])
                who, node, so_far = who[keep], node[keep], so_far[keep]
                if level:
                    many, node = self._children(level, node)
                    who, so_far = np.repeat(who, many), np.repeat(so_far, many)
            for part in range(0, len(who), 1 << 16):
                many, b = self._children(0, node[part : part + (1 << 16)])
                a = np.repeat(who[part : part + (1 << 16)], many)
                self.compared += len(a)
                keep = (np.bitwise_count(words[a] ^ words[b]) <= limit) & (group[a] != group[b])
                unite(group, a[keep], b[keep])
        first = np.full(n, n)
        np.minimum.at(first, group, self.order)  # the place, as given, of each group's first word
        out = np.empty(n, np.int64)
        out[self.order] = first[group]
        return out


def _blocks(n: int, bits: list[int]) -> list[int]:
    """Masks that cut the given bits into n blocks of nearly equal width."""
    edges = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(prints: DataFrame, limit: int) -> DataFrame:
    """Each fingerprint below each upper node that holds it: columns fp, fixed (mask), node (long)."""
    blocks = _blocks(limit + 2, list(range(64)))
    masks = [a | b for a, b in combinations(blocks, 2)]
    below = F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("fixed")
    return prints.select("fp", below).withColumn("node", F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed"))))


def _split(nodes: DataFrame, limit: int) -> DataFrame:
    """``nodes`` with those of over ``SPLIT_OVER`` fingerprints replaced by nodes of longer patterns.

    Words within ``limit`` bits that agree on the fixed bits also agree on one of ``limit + 1`` blocks of the rest, so
    that no link is lost. Three rounds leave 16 free bits or so, thus at most 2**16 distinct words, in any node.
    """
    while True:
        sizes = nodes.groupBy("fixed", "node").count()
        large = cut(sizes.where(F.col("count") > SPLIT_OVER).where(F.bit_count("fixed") < 48).select("fixed", "node"))
        if large.isEmpty():
            return nodes
        deeper = None
        for (fixed,) in large.select("fixed").distinct().collect():  # masks: a handful, whatever the input
            free = [b for b in range(64) if not fixed >> b & 1]
            finer = F.explode(F.array(*[F.lit(_signed((fixed & (1 << 64) - 1) | m)) for m in _blocks(limit + 1, free)])).alias("finer")
            part = nodes.where(F.col("fixed") == fixed).join(large, ["fixed", "node"], "left_semi").select("fp", "node", finer)
            part = part.select("fp", F.col("finer").alias("fixed"), F.xxhash64("node", "finer", F.col("fp").bitwiseAND(F.col("finer"))).alias("node"))
            deeper = part if deeper is None else deeper.unionByName(part)
        nodes = cut(nodes.join(large, ["fixed", "node"], "left_anti").unionByName(deeper))


def _links(nodes: DataFrame, limit: int) -> DataFrame:
    """Links (u, v) of fingerprints below each node: each linked one to the first of its group, so never more links than fingerprints."""

    def links(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """All links of whole runs of equal nodes."""
        new = np.concatenate(([True], node[1:] != node[:-1], [True]))
        some = ~(new[:-1] & new[1:])  # not alone in a node
        node, fp = node[some], fp[some]
        group = GrayIndex(fp.view(_U), node).link(limit) if len(fp) else np.empty(0, np.int64)
        linked = np.flatnonzero(group != np.arange(len(fp)))
        a, b = fp[linked], fp[group[linked]]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # rows from the start of a run on
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            held.append(rows)
            n += rows.shape[1]
            if n >= HELD:
                rows = np.concatenate(held, axis=1)
                other = np.flatnonzero(rows[0] != rows[0, -1])
                last = int(other[-1]) + 1 if len(other) else 0
                held, n = [rows[:, last:]], rows.shape[1] - last
                if last:
                    yield links(rows[0, :last], rows[1, :last])
        if n:
            yield links(*np.concatenate(held, axis=1))

    return nodes.select("node", "fp").repartition("node").sortWithinPartitions("node", "fp").mapInArrow(run, "u long, v long")


def near_prints(prints: DataFrame, limit: int = 3) -> DataFrame:
    """Links (u, v) between the fingerprints of a table with a column fp (distinct, signed): their chains are those of fingerprints within ``limit`` bits."""
    return _links(_split(_nodes(prints.select("fp"), limit), limit), limit)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id_col, fp long (the 64 bits, signed) and text_hash of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64)
            return pa.record_batch([batch.column(0), pa.array(out.view(np.int64)), batch.column(1)], names=[id_col, "fp", "text_hash"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    return map_batches(docs.select(col(id_col), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col)), make, f"`{id_col}` {kind}, fp long, text_hash long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """One row per document: id_col, fp long, text_hash, component_id (the smallest id that links of at most ``limit`` bits reach), root (a fingerprint that names the component).

    Null and texts without words have fingerprint zero and link like any other. Rows with a repeated id keep one row
    each. A null id never becomes a component's id; the component of null ids alone is null. Columns other than the two
    are not read. Documents of equal fingerprints count once in the search, however many they are.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    prints = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")))
    roots = components(near_prints(prints, limit))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "copies", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut(rooted.select("fp", "copies", "root").join(named, "root").select("fp", "copies", "component_id", "root"))
    return join_hot(marked, ids, "fp", "copies").select(id_col, "fp", "text_hash", "component_id", "root")


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that come first in their component; ``found`` has id, text_hash and root of each row."""
    each = found.groupBy("root", F.col("id").isNull().alias("no_id"), "id", "text_hash").agg(F.count("*").alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct("no_id", "id", "text_hash", "n")).alias("first"))
    no_id, i, text_hash, many = fresh(docs.columns, "no_id", "id", "text_hash", "many")
    # an id that is null counts as 0 beside the flag, so that the join is on plain equality
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    path = shared_path(docs.sparkSession, "first")
    first.select(F.col("first.no_id").alias(no_id), F.coalesce("first.id", zero).alias(i), F.col("first.text_hash").alias(text_hash), (F.col("first.n") > 1).alias(many)).write.parquet(path)
    rows = docs.withColumns({no_id: col(id_col).isNull(), i: F.coalesce(col(id_col), zero), text_hash: F.xxhash64(col(text_col))})
    # the written table has a known size, by which Spark decides whether to broadcast it; only rows that repeat are shuffled by it
    kept = rows.join(docs.sparkSession.read.parquet(path), [no_id, i, text_hash])
    repeated = kept.where(col(many)).dropDuplicates([no_id, i, text_hash])
    return kept.where(~col(many)).unionByName(repeated).drop(no_id, i, text_hash, many)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3, least: float | None = None) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one of the smallest id.

    Components are those of ``near_duplicates``; with ``least``, links need a Jaccard similarity of at least that over the
    shingles instead, and pairs beyond ``limit`` bits that have it are linked, too (tessera.llm.shingles). Null ids come
    last; of rows of one id the one of the smallest hash of its text stays, of equal rows any one.
    """
    if least is None:
        found = near_duplicates(docs, id_col, text_col, shingle, limit).select(col(id_col).alias("id"), "text_hash", "root")
    else:
        from tessera.llm import shingles  # which builds on this module

        found = shingles.near_duplicates(docs, id_col, text_col, shingle, least, limit)
    return first_of_each(docs, found, id_col, text_col)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint (16 hex digits), component_id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
