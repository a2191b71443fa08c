"""Edit-aware token counts.

A document keeps its pre-tokens in leaves of bounded width under a segment tree that sums characters and tokens. An edit
finds its leaves by the sums of characters, encodes again only the text of those leaves and as much context as the
pre-token boundaries need, and updates the sums on the paths above. The count is exactly that of encoding the edited text
as a whole.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import Remembered, vocabulary_path
from tessera.llm.common import map_batches, table

#: Pre-tokens of a leaf, and pre-tokens that a task remembers the counts of.
LEAF, CACHE = 32, 200_000


class Counter:
    """Pre-tokens and their token counts under a rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.counts = Remembered(lambda s: len(self.encoding.encode_ordinary(s)), CACHE)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Counter:
    """One counter a process and file."""
    return Counter(path, pattern)


class Document:
    """A text as leaves of pre-tokens under a segment tree; ``recounted`` adds up the pre-tokens that were encoded."""

    def __init__(self, text: str, counter: Counter, leaf: int = LEAF):
        self.counter, self.width, self.recounted = counter, leaf, 0
        self._build(counter.pieces(text))

    def _build(self, pieces: list[str]) -> None:
        leaves = [pieces[k : k + self.width] for k in range(0, len(pieces), self.width)] or [[]]
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.leaves = leaves + [[] for _ in range(self.size - len(leaves))]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, piece in enumerate(leaves):
            self._weigh(k, piece)
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _weigh(self, k: int, pieces: list[str]) -> None:
        counts = self.counter.counts
        self.leaves[k] = pieces
        self.chars[self.size + k] = sum(map(len, pieces))
        self.tokens[self.size + k] = sum([counts[p] for p in pieces])
        self.recounted += len(pieces)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(["".join(x) for x in self.leaves])

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at this place, and the place of its first character; the last one beyond the end."""
        at, k, start = min(at, max(self.n_chars - 1, 0)), 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end (exclusive, both cut to the text) by ``new``."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, at = self._leaf_at(max(start - 1, 0))
        last, last_at = self._leaf_at(end)
        # context: a pre-token depends on white space and the characters on either side of it, so a region starts and
        # ends where a new encoding keeps a boundary: before a piece that the edit does not touch, after two of them
        while True:
            before = "".join(["".join(x) for x in self.leaves[first : last + 1]])
            changed = before[: start - at] + new + before[end - at :]
            pieces = self.counter.pieces(changed)
            left = first == 0 or self._same(pieces[:2], self._head(first, last, start - at, 2))
            right = self._right(last) is None or self._same(pieces[-2:], self._tail(first, last, end - at, 2))
            if left and right:
                break
            if not left:
                first = self._left(first)
                at -= self.chars[self.size + first]
            if not right:
                last = self._right(last)
        self._replace(first, last, pieces)

    def _left(self, k: int) -> int:
        k -= 1
        while k > 0 and not self.leaves[k]:
            k -= 1
        return k

    def _right(self, k: int) -> int | None:
        """The next leaf with text after this one, found through the tree."""
        node = self.size + k
        while node > 1:
            if node % 2 == 0 and self.chars[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.chars[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None

    @staticmethod
    def _same(new: list[str], old: list[str] | None) -> bool:
        return old is not None and new == old

    def _head(self, first: int, last: int, limit: int, n: int) -> list[str] | None:
        """The region's first n pieces, if all end by ``limit`` characters from its start; they hold a piece that is not white space."""
        found, at = [], 0
        for leaf in self.leaves[first : last + 1]:
            for p in leaf:
                at += len(p)
                if at > limit:
                    return None
                found.append(p)
                if len(found) == n:
                    return found
        return None

    def _tail(self, first: int, last: int, limit: int, n: int) -> list[str] | None:
        """The region's last n pieces, if all start at ``limit`` characters or later from its start."""
        found, at = [], sum(self.chars[self.size + k] for k in range(first, last + 1))
        for leaf in reversed(self.leaves[first : last + 1]):
            for p in reversed(leaf):
                at -= len(p)
                if at < limit:
                    return None
                found.insert(0, p)
                if len(found) == n:
                    return found
        return None

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        slots = last - first + 1
        if len(pieces) > 4 * self.width * slots:
            self._build([*(p for x in self.leaves[:first] for p in x), *pieces, *(p for x in self.leaves[last + 1 :] for p in x)])
            return
        step = -(-len(pieces) // slots) if pieces else 1
        for k in range(slots):
            self._weigh(first + k, pieces[k * step : (k + 1) * step])
        touched = {(self.size + k) // 2 for k in range(first, last + 1)}
        while touched and 0 not in touched:
            for k in touched:
                self._sum(k)
            touched = {k // 2 for k in touched}


@dataclass(frozen=True)
class Edit:
    """Replaces code points from start to end (exclusive) by text."""

    start: int
    end: int
    text: str


def sample_edits(n: int) -> list[Edit]:
    """The edits that the query applies to a text of n code points, one after the other: a word is inserted, a passage cut, a mark replaced."""
    return [Edit(n // 2, n // 2, " inserted words "), Edit(n // 4, n // 4 + n // 50, ""), Edit(3 * n // 4, 3 * n // 4 + 1, "'s!\n")]


def counted(docs: DataFrame, path: str, pattern: str, edits=sample_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text and of the text after ``edits(n_chars)``.

    Returns id_col, n_tokens, n_pieces (pre-tokens), edited_tokens, edited_chars, edited_sha256, recounted_pieces (what the
    edits encoded again). Null and empty texts have no tokens; edits beyond a text's end are cut to it. Rows with a null
    or repeated id stay as they are; other columns are not read. Memory is bounded by one text and the caches.
    """

    def make():
        counter = load(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(6)]
            for t in batch.column(1):
                text = t.as_py() or ""
                doc = Document(text, counter)
                n, pieces = doc.n_tokens, doc.recounted
                for e in edits(len(text)):
                    doc.edit(e.start, e.end, e.text)
                row = (n, pieces, doc.n_tokens, doc.n_chars, hashlib.sha256(doc.text().encode("utf-8", "surrogatepass")).hexdigest(), doc.recounted - pieces)
                for c, x in zip(columns, row):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[id_col, "n_tokens", "n_pieces", "edited_tokens", "edited_chars", "edited_sha256", "recounted_pieces"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, n_pieces long, edited_tokens long, edited_chars long, edited_sha256 string, recounted_pieces long")


def op3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, counted with the byte-level BPE of 50,256 ranks before and after three edits each."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return counted(docs, vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
