"""A quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import STEP_ROWS, col, map_batches, small_batches, table

#: At most so many labelled rows are fitted on, the least by a hash of their id: a documented bound.
TRAIN_ROWS = 20_000
FEATURES = (
    "log_words", "log_bytes", "word_length", "upper", "digit", "space", "sentence_marks", "other_marks", "not_ascii", "distinct_words",
    "top_word", "next_same", "words_per_line", "log_lines", "marked_words", "capital_words", "long_words", "distinct_lines", "one_sign_words", "log_longest_word",
)
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".,;:?'\"-()"]] = True
_OTHER = np.zeros(256, bool)
_OTHER[0x21:0x7F] = True
_OTHER &= ~(_SENTENCE | _DIGIT)
_OTHER[0x41:0x5B] = _OTHER[0x61:0x7B] = False


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text in the order of ``FEATURES``; those of the empty text for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n = raw.split(), max(len(raw), 1)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts, w = Counter(words), max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in raw.splitlines() if x.strip()]
    marks = sum(c for x, c in counts.items() if not x[-1:].isalnum() and x[-1:] not in b".,;:?)'\"" and x[-1] < 0x80)
    return [
        float(np.log1p(len(words))),
        float(np.log1p(len(raw))),
        float(lengths.mean()),
        by_byte[_UPPER].sum() / n,
        by_byte[_DIGIT].sum() / n,
        by_byte[_SPACE].sum() / n,
        by_byte[_SENTENCE].sum() / n,
        by_byte[_OTHER].sum() / n,
        by_byte[0x80:].sum() / n,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        len(words) / max(len(lines), 1),
        float(np.log1p(len(lines))),
        marks / w,
        sum(c for x, c in counts.items() if x[:1].isupper()) / w,
        float((lengths > 12).mean()),
        len(set(lines)) / max(len(lines), 1),
        float((lengths == 1).mean()),
        float(np.log1p(lengths.max())),
    ]


@dataclass
class Trees:
    """Boosted trees as flat arrays: node i tests feature[i] <= threshold[i] and goes to left[i] or right[i]; leaves go to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least_rows: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted regression trees for the logistic loss, grown level by level on histograms of binned features.

    Without rows, every score is 0.5; with labels of one kind only, all scores are that label's smoothed share. Ties of
    gain go to the first feature and the lowest bin, so that a fit on the same rows in the same order is the same.
    """
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1) if n else np.empty((0, k), np.int64)
    flat = binned + np.arange(k) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def new(v: float = 0.0) -> int:
        i = len(value)
        for a, b in ((feature, 0), (threshold, 0.0), (left, i), (right, i), (value, v)):
            a.append(b)
        return i

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(new())
        open_, at = [roots[-1]], np.zeros(n, np.int64)  # at: each row's place among the open nodes, -1 once in a leaf
        row_node = np.full(n, roots[-1])
        for level in range(depth + 1):
            m = len(open_)
            live = np.flatnonzero(at >= 0)
            key = (at[live, None] * (k * bins) + flat[live]).ravel()
            size = m * k * bins
            hist = [np.bincount(key, None if w is None else np.repeat(w[live], k), size).reshape(m, k, bins) for w in (g, h, None)]
            sums = [a[:, 0, :].sum(axis=1) for a in hist]
            score = sums[0] ** 2 / (sums[1] + ridge)
            if level < depth:
                lo = [a.cumsum(axis=2) for a in hist]
                hi = [s[:, None, None] - a for s, a in zip(sums, lo)]
                gain = lo[0] ** 2 / (lo[1] + ridge) + hi[0] ** 2 / (hi[1] + ridge) - score[:, None, None]
                gain[(lo[2] < least_rows) | (hi[2] < least_rows)] = -np.inf
                best = gain.reshape(m, -1).argmax(axis=1)
                top = gain.reshape(m, -1)[np.arange(m), best]
            nxt, to = [], np.full((m, 2), -1)
            for i, node in enumerate(open_):
                if level == depth or not top[i] > 1e-6:
                    value[node] = float(-rate * sums[0][i] / (sums[1][i] + ridge))
                    continue
                j, b = divmod(int(best[i]), bins)
                feature[node], threshold[node] = j, float(edges[j][b])
                left[node], right[node] = new(), new()
                to[i] = len(nxt), len(nxt) + 1
                nxt += [left[node], right[node]]
            if not nxt:
                break
            splits = np.array([feature[node] for node in open_])
            limit = np.array([int(b % bins) for b in best])
            right_of = binned[live, splits[at[live]]] > limit[at[live]]
            moved = to[at[live], right_of.astype(int)]
            row_node[live[moved >= 0]] = np.array(nxt)[moved[moved >= 0]]
            at[live] = moved
            open_ = nxt
        margin = margin + np.array(value)[row_node]
    ints = lambda a: np.array(a, np.int64)
    return Trees(ints(roots), ints(feature), np.array(threshold), ints(left), ints(right), np.array(value), depth, base)


def held_out(id_col: str = "doc_id"):
    """The rows that no fit may see: crc32 of the id as text leaves 2 modulo 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on the labelled rows that are not held out: the ``train_rows`` least by a hash of their id.

    Labels that are null, held out or of no document do not count; of repeated labels of an id the greatest does. Only
    ids and labels up to the bound are broadcast, and only their statistics come to the driver.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where("_id is not null and _y is not null").where(~held_out("_id"))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pa.array([statistics(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))
            return pa.record_batch([batch.column(0), batch.column(1), x], names=["_id", "_y", "x"])

        return step

    got = map_batches(rows, make, f"_id {labels.schema[id_col].dataType.simpleString()}, _y int, x array<double>").toPandas()
    got = got.sort_values(["_id", "x"], key=lambda c: c.map(tuple) if c.name == "x" else c)
    x = np.stack(got["x"].to_list()) if len(got) else np.empty((0, len(FEATURES)))
    return fit(x, (got["_y"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score double (0 to 1, higher: label 1 likelier) of every row, from its whole text alone; null texts score as empty ones."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)])
            return pa.record_batch([batch.column(0), pa.array(model.score(x))], names=[id_col, "score"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, score double")


def filtered(docs: DataFrame, model: Trees, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score at least ``threshold``. Only texts go to Python, and only scores come back."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        out = [model.score(np.array([statistics(t.as_py()) for t in text[at : at + STEP_ROWS]])) for at in range(0, len(text), STEP_ROWS)]
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    small_batches(docs.sparkSession)
    return docs.where(score(col(text_col).cast("string")) >= threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
