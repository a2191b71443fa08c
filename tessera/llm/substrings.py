"""Removal of repeated passages by hashing lines, sentences and parts of long sentences.

A text is cut into units that do not overlap: lines, within lines sentences, and within long sentences parts that end after
words which the text itself singles out (the strictly least hash of the seven words around), as a passage that is copied
into another text often starts and ends inside a sentence, and such cuts fall on the same words in both. Sequences of
sentences of under ``LONG_SENTENCE`` words in a line, or of lines of under ``long_unit`` words, make one unit or several of
at least ``long_unit`` words, which end where the sentences' own hashes say so. A unit's normal form is its words in lower case without outer punctuation, so that case and spacing do not hide a
copy, and its digest is the 128-bit BLAKE2 of that. What is left of under ``long_unit`` words between two units counts
together with both (or the line's end), as so few words repeat by chance; at the text's start or end, where a text has other
units, such a rest stays.

Digests are grouped over all documents. The occurrence of the lowest rank (document id, then place) stays; the others are
repeats. A run of neighbouring repeats goes if it holds at least ``least_words`` words; the minimum is for parts of a line,
and a whole line of at least ``least_line`` words goes wherever an earlier one has the same words, and so does a whole text.
Every unit is either kept or gone as a whole: nothing goes without a digest of its own that an earlier unit has, too, and
what is kept for others is never cut.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, fresh, heavy_values, map_batches, shared_path, small_batches, table

#: Words that a run of less than a line holds at least to go, that a line holds at least to go by itself, that a sentence holds at least to be a unit, and that a unit of shorter ones holds at least; words on either side that a cut inside a sentence looks at.
LEAST_WORDS, LEAST_LINE, LONG_SENTENCE, LONG_UNIT, AROUND = 10, 6, 6, 4, 3
#: Words after which a sequence of short units without an end of its own is cut.
CUT_SHORT = 16
_SPACE, _OUTER = np.zeros(0x3002, bool), np.zeros(0x3002, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
_OUTER[[ord(c) for c in ".,;:!?()[]{}\"'"]] = True
#: Odd powers, one for each place in a word, with which a word's characters are added up for the places of cuts.
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


class Units:
    """The units of a text: ``starts`` (code points, each unit's first and the text's size at the end), ``words`` (words of each), ``line`` (the long line that each is part of, else -1) and ``digests`` (None: never goes)."""

    def __init__(self, text: str, long_unit: int = LONG_UNIT, around: int = AROUND):
        self.starts, self.words, self.line, self.digests = [0], [], [], []
        low = text.lower()
        if len(low) != len(text):  # a few capitals have two characters in lower case
            low = "".join([x if len(x := c.lower()) == 1 else c for c in text])
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.minimum(points, 0x3001)
        space = _SPACE[kind]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        n = len(first)
        if not n:
            return
        solid = np.flatnonzero(~(space | _OUTER[kind]))
        lo, hi = np.searchsorted(solid, first), np.searchsorted(solid, last)
        whole = lo < hi  # words with more than punctuation
        a = solid[np.minimum(lo, len(solid) - 1)] if len(solid) else first
        b = solid[hi - 1] + 1 if len(solid) else first
        a, b = np.where(whole, a, 0), np.where(whole, b, 0)
        # the normal form of the text: its words without outer punctuation, a blank after each
        take = np.zeros(len(points) + 1, np.int8)
        np.add.at(take, a[whole], 1)
        np.add.at(take, b[whole], -1)
        take = np.cumsum(take, dtype=np.int8) > 0
        take[b[whole]] = True
        normal = np.append(points, np.uint32(0x20))
        normal[b[whole]] = 0x20
        self._normal = normal[take].astype("<u4").tobytes()
        size = np.where(whole, b - a + 1, 0)
        self._at = np.concatenate(([0], np.cumsum(size) * 4))
        line = np.searchsorted(np.flatnonzero(points == 10), first)
        ends = np.ones(n, bool)  # whether a unit ends after the word
        ends[:-1] = (line[1:] != line[:-1]) | np.isin(points[last[:-1] - 1], (0x2E, 0x21, 0x3F))
        weight = self._hashes(points, a, b, whole) if n else None
        width, inside = 2 * around + 1, np.empty(0, np.int64)
        if n > width:
            sentence = np.concatenate(([0], np.cumsum(ends[:-1])))
            middle = np.arange(around, n - around - 1)
            middle = middle[sentence[middle - around] == sentence[middle + around + 1]]
            if len(middle):
                near = np.lib.stride_tricks.sliding_window_view(weight, width)[middle - around]
                inside = middle[(near <= weight[middle, None]).sum(axis=1) == 1]
                ends[inside] = True
        cuts = np.concatenate(([0], np.flatnonzero(ends) + 1))
        counted = np.concatenate(([0], np.cumsum(whole)))
        part = np.isin(cuts[1:] - 1, inside) | np.isin(cuts[:-1] - 1, inside)
        of_line = np.bincount(line, whole, minlength=line[-1] + 1)
        place = np.where(of_line[line[cuts[:-1]]] >= long_unit, line[cuts[:-1]], -1)
        self._group(cuts.tolist(), np.diff(counted[cuts]).tolist(), part.tolist(), place.tolist(), weight, long_unit)
        starts = first[self._cuts[:-1]]
        starts[0] = 0
        self.starts = [*starts.tolist(), len(points)]

    @staticmethod
    def _hashes(points: np.ndarray, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """A hash of each word, for the places of cuts only; words of nothing but punctuation have the greatest."""
        out = np.full(len(a), np.uint64(2**64 - 1))
        a, size = a[whole], (b - a)[whole]
        if len(a):
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            x = (points[np.repeat(a, size) + inside].astype(np.uint64) + np.uint64(1)) * _POWERS[inside & 63]
            x = np.add.reduceat(x, np.cumsum(size) - size)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out[whole] = x ^ (x >> np.uint64(32))
        return out

    def _digest(self, a: int, b: int) -> bytes:
        return blake2b(self._normal[self._at[a] : self._at[b]], digest_size=16).digest()

    def _group(self, cuts: list[int], words: list[int], part: list[bool], line: list[int], weight: np.ndarray, long_unit: int) -> None:
        """Puts short sentences together, and hashes all."""
        long = [n >= LONG_SENTENCE or is_part and n > 0 for n, is_part in zip(words, part)]
        found: list[tuple[int, int, int, int]] = []  # first word, end, words, line
        left: set[int] = set()  # what is too short to be hashed alone
        at = 0
        while at < len(words):
            if long[at]:
                found.append((cuts[at], cuts[at + 1], words[at], line[at]))
                at += 1
                continue
            end = at
            while end < len(words) and not long[end] and line[end] == line[at]:
                end += 1
            if sum(words[at:end]) < long_unit:
                left.add(len(found))
                found.append((cuts[at], cuts[end], sum(words[at:end]), line[at]))
            else:
                mark = [int(weight[x:y].min()) if n else 2**64 for x, y, n in zip(cuts[at:end], cuts[at + 1 :], words[at:end])]
                for x, y in sequences(words[at:end], mark, long_unit):
                    found.append((cuts[at + x], cuts[at + y], sum(words[at + x : at + y]), line[at]))
            at = end
        own = [self._digest(a, b) for a, b, _, _ in found]
        self._cuts = [*[x[0] for x in found], cuts[-1]]
        self.words, self.line = [x[2] for x in found], [x[3] for x in found]
        self.digests = list(own)
        for k in left:
            if len(found) == 1:
                continue  # all of the text
            beside = []
            for j in (k - 1, k + 1):
                inside = 0 <= j < len(found)
                if inside and found[j][3] == found[k][3] or inside and found[k][3] < 0:
                    beside.append(own[j])
                else:
                    beside.append(b"line" if found[k][3] >= 0 else None)
            self.digests[k] = None if None in beside or not self.words[k] else blake2b(beside[0] + own[k] + beside[1], digest_size=16, person=b"between").digest()


def sequences(words: list[int], mark: list[int], long_unit: int) -> list[tuple[int, int]]:
    """First and end of each part of a sequence of short units, which together hold ``long_unit`` words at least.

    A part ends after a unit with a mark below those of the nearest units on either side that have words, so that copies
    between different neighbours are cut alike; a part of too few words goes with the next one. Parts without such an end
    are cut by length.
    """
    ends: list[int] = []
    some = [k for k, n in enumerate(words) if n]
    for x, k in enumerate(some[:-1]):
        if (x == 0 or mark[k] < mark[some[x - 1]]) and mark[k] < mark[some[x + 1]] and sum(words[ends[-1] if ends else 0 : k + 1]) >= long_unit:
            ends.append(k + 1)
    if ends and sum(words[ends[-1] :]) < long_unit:
        del ends[-1]
    found = []
    for a, b in zip([0, *ends], [*ends, len(words)]):
        left, held = sum(words[a:b]), 0
        for k in range(a, b):
            held += words[k]
            if held >= CUT_SHORT and left - held >= CUT_SHORT:
                found.append((a, k + 1))
                a, left, held = k + 1, left - held, 0
        found.append((a, b))
    return found


def gone(words: list[int], line: list[int], repeats: set[int], least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> list[int]:
    """The units that go, of those that are repeats: runs of enough words, whole long lines, and whole texts."""
    out: list[int] = []
    for is_repeat, run in groupby(range(len(words)), repeats.__contains__):
        run = list(run)
        if not is_repeat:
            continue
        if sum(words[k] for k in run) >= least_words or len(run) == len(words):
            out += run
            continue
        for number, part in groupby(run, line.__getitem__):
            part = list(part)
            whole = (part[0] == 0 or line[part[0] - 1] != number) and (part[-1] == len(words) - 1 or line[part[-1] + 1] != number)
            if number >= 0 and whole and sum(words[k] for k in part) >= least_line:
                out += part
    return out


def spans(starts: list[int], units: list[int], kept: dict[int, tuple]) -> list[tuple[int, int, int | None]]:
    """Start, end and the kept document's id of each passage: neighbouring units that stand one after the other in one kept document."""
    found: list[tuple[int, int, int | None]] = []
    before = None
    for k in units:
        no_id, i, h, place = kept[k]
        if before == (k - 1, no_id, i, h, place - 1):
            found[-1] = (found[-1][0], starts[k + 1], found[-1][2])
        else:
            found.append((starts[k], starts[k + 1], None if no_id else i))
        before = (k, no_id, i, h, place)
    return found


#: What stands for a row: whether its id is null, the id (0 if null), and a hash of its text.
_ROW = ("no_id", "id", "hash")


def _row(id_col: str, text_col: str) -> dict:
    i = col(id_col).cast("long")
    return {"no_id": i.isNull(), "id": F.coalesce(i, F.lit(0).cast("long")), "hash": F.xxhash64(col(text_col))}


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_unit: int = LONG_UNIT) -> DataFrame:
    """One row per row: no_id, id, hash, sizes (code points of each unit), words, line (as in ``Units``) and digests (array of two longs a unit, null for what never goes), written to the shared folder."""
    spark = docs.sparkSession

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[], [], []]
            digests, sizes, known = [], [], []
            for t in batch.column(3):
                of_text = Units(t.as_py() or "", long_unit)
                starts = of_text.starts
                for c, x in zip(columns, ([b - a for a, b in zip(starts, starts[1:])], of_text.words, of_text.line)):
                    c.append(x)
                digests += [d or b"\0" * 16 for d in of_text.digests]
                known += [d is not None for d in of_text.digests]
                sizes.append(len(of_text.digests))
            two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["a", "b"], mask=pa.array(~np.array(known, bool)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pairs)
            return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, pa.list_(pa.int32())) for c in columns], lists], names=[*_ROW, "sizes", "words", "line", "digests"])

        return step

    small_batches(spark)
    rows = docs.select(*[c.alias(n) for n, c in _row(id_col, text_col).items()], col(text_col).cast("string").alias("text"))
    path = shared_path(spark, "units")
    map_batches(rows, make, "no_id boolean, id long, hash long, sizes array<int>, words array<int>, line array<int>, digests array<struct<a: long, b: long>>").write.parquet(path)
    return spark.read.parquet(path)


def repeated_units(found: DataFrame) -> DataFrame:
    """Every occurrence of a unit but the kept one, of rows as ``units`` gives them: no_id, id, hash, unit, kept (no_id, id, hash, unit).

    Occurrences are shuffled once, by their digest. A digest that over a thousandth of all occurrences have is not: of these
    the first occurrence is aggregated and travels as a literal, at most ``HOT_KEYS`` of them.
    """
    each = found.select(*_ROW, F.posexplode("digests").alias("unit", "d")).where("d is not null").select(*_ROW, "unit", "d.a", "d.b")
    place = F.struct(*_ROW, "unit")
    hot = heavy_values(each, "a")
    others = each.where(~F.col("a").isin(hot)) if hot else each
    out = others.withColumn("kept", F.min(place).over(Window.partitionBy("a", "b"))).select(*_ROW, "unit", "kept")
    if hot:
        hot_ones = each.where(F.col("a").isin(hot))
        first = hot_ones.groupBy("a", "b").agg(F.min(place).alias("kept")).select("a", "b", "kept.*").collect()
        at = lambda c: F.element_at(F.array(*[F.lit(r[c]) for r in first]).cast(f"array<{'boolean' if c == 'no_id' else 'int' if c == 'unit' else 'bigint'}>"), F.col("at"))
        hot_ones = hot_ones.withColumn("at", F.array_position(F.array(*[F.lit(r.a) for r in first]).cast("array<bigint>"), F.col("a")).cast("int"))
        # the halves beside equal ones are equal, too, but for a chance of 2**-64
        kept = F.when(at("b") == F.col("b"), F.struct(*[at(c).alias(c) for c in (*_ROW, "unit")])).otherwise(place)
        out = out.unionByName(hot_ones.select(*_ROW, "unit", kept.alias("kept")))
    return out.where(place != F.col("kept"))


def passages(found: DataFrame, least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> DataFrame:
    """no_id, id, hash and spans (array of start, end, kept_id) of each row that loses a passage. Rows of equal id and text count as one."""
    repeats = repeated_units(found).groupBy(*_ROW).agg(F.collect_set(F.struct("unit", "kept")).alias("repeats"))
    rows = found.select(*_ROW, "sizes", "words", "line").join(repeats, list(_ROW))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept_id", pa.int64())]))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for sizes, words, line, repeated in zip(*[batch.column(k) for k in range(3, 7)]):
                kept = {x["unit"]: tuple(x["kept"].values()) for x in repeated.as_py()}
                goes = gone(words.as_py(), line.as_py(), set(kept), least_words, least_line)
                out.append([{"start": a, "end": b, "kept_id": k} for a, b, k in spans([0, *accumulate(sizes.as_py())], goes, kept)])
            return pa.record_batch([*[batch.column(k) for k in range(3)], pa.array(out, kind)], names=[*_ROW, "spans"])

        return step

    cuts = map_batches(rows, make, "no_id boolean, id long, hash long, spans array<struct<start: long, end: long, kept_id: long>>")
    return cuts.where(F.size("spans") > 0).dropDuplicates(list(_ROW))


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """The texts without the ranges of code points; null for null."""
    out = []
    for t, a, b in zip(text, starts, ends):
        t = t.as_py()
        if t is not None:
            t = "".join([t[x:y] for x, y in zip([0, *b.as_py()], [*a.as_py(), len(t)])])
        out.append(t)
    return pa.array(out, pa.string())


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "removed", long_unit: int = LONG_UNIT, least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> DataFrame:
    """``docs``, all rows and columns, its texts without repeated passages, and ``spans_col``: what was cut out.

    ``spans_col`` is an array of (start, end, kept_id): code points in the original text, end exclusive, and the id of the
    document that keeps the passage; one entry for each kept document. It is empty where nothing was cut, and takes the
    place of a column of that name. Ranks are ids as integers, null last; rows of equal id and equal text count as one row,
    and all get its result. Null texts stay null. Other columns may have any name. Only a text's
    units go through the shuffles, and then the text once. Only texts that
    lose something are cut by Python, all others stay in the JVM.
    """
    cuts = passages(units(docs, id_col, text_col, long_unit), least_words, least_line)
    names = dict(zip((*_ROW, "spans"), fresh(docs.columns, *_ROW, "spans")))
    cuts = cuts.select(*[F.col(k).alias(v) for k, v in names.items()])
    rows = docs.withColumns({names[k]: c for k, c in _row(id_col, text_col).items()}).join(cuts, [names[k] for k in _ROW], "left")
    found = col(names["spans"])
    changed = F.when(found.isNotNull(), col(text_col).cast("string"))
    new = _without(changed, F.coalesce(found["start"], F.array().cast("array<long>")), F.coalesce(found["end"], F.array().cast("array<long>")))
    text = F.coalesce(new, col(text_col).cast("string"))
    none = F.array().cast("array<struct<start: bigint, end: bigint, kept_id: bigint>>")
    kept = [c for c in docs.columns if c != spans_col]
    return rows.select(*[text.alias(c) if c == text_col else col(c) for c in kept], F.coalesce(found, none).alias(spans_col))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_removed, removed_chars, removed (start, end, kept_id), kept_ids, text (what stays)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return deduplicated(docs).select("doc_id", F.size("removed").alias("n_removed"), chars.alias("removed_chars"), "removed", F.array_distinct("removed.kept_id").alias("kept_ids"), "text")
