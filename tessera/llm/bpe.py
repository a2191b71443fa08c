"""BPE encoding and decoding by a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, small_batches, table

#: Words that a task remembers before the older half is forgotten. Only speed depends on it.
CACHE_WORDS = 100_000
_ID = 1 << 16  # ids fit in 16 bits; a pair of them is one int


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for the code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Remembered(dict):
    """A dict of bounded size: once ``most`` new keys have come, those not used since the last time are forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBPE:
    """A tokenizer read from a ``tokenizers`` JSON file: lower case, words with an end-of-word suffix, byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if max(vocab.values()) >= _ID:
            raise ValueError("vocabularies of more than 65536 entries are not supported")
        suffix = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + suffix) for s in symbols]
        #: pair of ids -> rank and merged id, in one int
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 16 | vocab[b], rank << 48 | vocab[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.by_chunk = Remembered(self._chunk, CACHE_WORDS)

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols after all merges: the lowest rank first, the leftmost of equal ranks."""
        n, get = len(ids), self.merges.get
        # an entry is rank, place and merged id in one int, so that rank and then place order the queue
        queue = [m | i << 16 for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get(a << 16 | b)) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            x = pop(queue)
            i = x >> 16 & 0xFFFFFFFF
            j = right[i]
            if j < 0 or (a := ids[i]) < 0 or (m := get(a << 16 | ids[j])) is None or m | i << 16 != x:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = (new := x & 0xFFFF), -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (m := get(new << 16 | ids[k])) is not None:
                    push(queue, m | i << 16)
            if (h := left[i]) >= 0 and (m := get(ids[h] << 16 | new)) is not None:
                push(queue, m | h << 16)
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]  # bytes that the vocabulary lacks have no id
        ids = self.merge(ids)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # letters only are one word
            return self._word(chunk)
        words = self.words.findall(chunk)
        if len(words) == 1 and words[0] == chunk:
            return self._word(chunk)
        by_chunk = self.by_chunk
        return b"".join([by_chunk[w] for w in words])

    def _plain(self, text: str) -> bytes:
        """Ids of text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()  # no final sigma: each character on its own
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split, not for the pattern
                return self._chunk(text)
        else:
            text = text.lower()
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return self._chunk(text)
        by_chunk = self.by_chunk
        return b"".join([by_chunk[w] for w in text.split()])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        if self.at_special is None or "<" not in text:
            return self._plain(text)
        return b"".join([self.special[s].to_bytes(4, "little") if i % 2 else self._plain(s) for i, s in enumerate(self.at_special.split(text))])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, put together with single spaces, as the file names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in memoryview(ids).cast("I").tolist()])


@lru_cache(maxsize=4)
def load(path: str) -> WordBPE:
    """One tokenizer a process and file."""
    return WordBPE(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: str = "text") -> DataFrame:
    """Token ids of every whole text, and the text decoded from them: id_col, n_tokens long, ids array<int>, decoded string.

    With ``decoded="sha256"`` the decoded text stays in the worker and the last column is decoded_sha256, its digest. Null
    and empty texts have no tokens and decode to the empty string. Rows with a null or repeated id stay as they are; other
    columns are not read. ``vocabulary`` is a path that every executor can open.
    """
    last = "decoded" if decoded == "text" else "decoded_sha256"

    def make():
        bpe = load(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(t.as_py()) for t in batch.column(1)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
            texts = map(bpe.decode, ids)
            if decoded != "text":
                texts = (hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts)
            return pa.record_batch([batch.column(0), pa.array(n), lists, pa.array(list(texts), pa.string())], names=[id_col, "n_tokens", "ids", last])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids array<int>, {last} string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests in place of ids and decoded texts, so that these never leave the worker: id_col, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        bpe = load(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, of_ids, of_text = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded with the word BPE of 49,408 ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs, vocabulary_path())
