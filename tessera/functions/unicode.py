"""Unicode steps that Spark SQL has no function for: normal forms, script detection, romanisation. Arrow batches, one value each."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Script labels by the first and last code point of their blocks.
BLOCKS = (
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("arabic", 0x0600, 0x06FF), ("latin", 0x0000, 0x024F),
)
#: The Indic blocks share one layout; these are its letters in IAST by their place in the block.
_VOWELS = dict(zip(range(0x05, 0x15), "a ā i ī u ū ṛ ḷ e e e ai o o o au".split()))
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n n p ph b bh m y r r l ḷ ḻ v ś ṣ s h".split()))
_SIGNS = dict(zip(range(0x3E, 0x4D), "ā i ī u ū ṛ ṝ e e e ai o o o au".split()))
_MARKS = {0x01: "m̐", 0x02: "ṃ", 0x03: "ḥ"}
_VIRAMA = 0x4D


def script_of(s: str) -> str:
    """The script of most characters that are not white space, punctuation, numbers or separators; the first seen of equals. 'empty' without any."""
    counts: dict[str, int] = {}
    for c in s:
        if c.isspace() or unicodedata.category(c)[0] in "PNZ":
            continue
        label = next((n for n, a, b in BLOCKS if a <= ord(c) <= b), "other")
        counts[label] = counts.get(label, 0) + 1
    return max(counts, key=counts.get) if counts else "empty"


def romanised(s: str, script: str) -> str:
    """Latin text stays; the Indic scripts go to IAST; all else loses what ASCII cannot hold."""
    if script == "latin":
        return s
    start = next((a for n, a, _ in BLOCKS[:8] if n == script), None)
    if start is None:
        return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    out, open_ = [], False  # open_: a consonant whose inherent vowel is still to be written
    for c in s:
        k = ord(c) - start
        if open_ and k not in _SIGNS and k != _VIRAMA:
            out.append("a")
        open_ = k in _CONSONANTS
        out.append(_CONSONANTS.get(k) or _SIGNS.get(k) or _VOWELS.get(k) or _MARKS.get(k) or ("" if k == _VIRAMA else str(k - 0x66) if 0x66 <= k <= 0x6F else c))
    return "".join(out) + ("a" if open_ else "")


_READ = T.StructType([T.StructField("form", T.StringType()), T.StructField("script", T.StringType()), T.StructField("roman", T.StringType()), T.StructField("ok", T.IntegerType())])


@F.pandas_udf(_READ)
def read_text(values: pd.Series) -> pd.DataFrame:
    """The NFKC form, its script, its romanisation, and whether that went well. Null counts as empty."""
    rows = []
    for v in values:
        form = unicodedata.normalize("NFKC", v) if v else ""
        script = script_of(form)
        try:
            rows.append((form, script, romanised(form, script), 1))
        except (ValueError, KeyError):
            rows.append((form, script, form, 0))
    return pd.DataFrame(rows, columns=["form", "script", "roman", "ok"])


@F.pandas_udf(T.StringType())
def plain_lower(values: pd.Series) -> pd.Series:
    """Without combining marks, in lower case."""
    return values.map(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower() if v else "")
