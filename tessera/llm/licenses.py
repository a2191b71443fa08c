"""Licence scans by a positional index of rare words.

Every licence template is a sequence of words. The licence words' document frequencies over the corpus give their IDF. Of
each file the licence words with the highest IDF are looked up: for a template, as many of those that the file holds as
have more of the template's IDF together than a place that is found can lack, so that at least one of them is in its place
there. Each place of such a word in a file proposes a place for the template, the postings of the template's other words
are intersected with it by relative position, and the file's share of the template's IDF is the score. A template is found
where its share reaches ``least`` and the words of its mandatory key phrase all stand in their places. Everything is
DataFrame expressions on one row a file; nothing is shuffled but the counts of licence words. The texts are read twice, for
the frequencies and for the places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, table

#: What separates words once A-Z are lower case: all ASCII but digits and a-z.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence text's words; ``key`` is the part of it, as (first, end), that must stand there word by word."""

    label: str
    text: str
    key: tuple[int, int] | None = None

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def mandatory(self) -> tuple[int, int]:
        return self.key or (0, len(self.words))


#: The most that a template in part can score.
NEARLY = 0.999
#: The base phrases; every place of each is counted.
BASE = (Template("gpl", "gnu general public license"), Template("apache", "apache license"), Template("cc-by", "cc by"), Template("mit", "mit license"))
#: Longer templates with labels of the method's own.
MORE = (
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", (0, 8)),
    Template("apache-2.0", "licensed under the apache license version 2 0", (3, 8)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", (0, 6)),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", (18, 22)),
    Template("cc-by-4.0", "licensed under cc by 4 0", (2, 6)),
    Template("cc-by-sa", "cc by sa"),
    Template("public-domain", "released into the public domain", (3, 5)),
    Template("proprietary", "all rights reserved"),
    Template("cc-by-nc", "cc by nc"),
    # Notices as the licences' own texts have them, fixed values; the key phrase is what names the licence or the grant.
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", (0, 6)),
    Template("bsd-notice", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", (0, 6)),
    Template("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", (3, 8)),
    Template("apache-warranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", (0, 9)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", (18, 22)),
    Template("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", (5, 11)),
    Template("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", (11, 14)),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", (0, 4)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", (2, 6)),
    Template("boost-notice", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", (9, 12)),
    Template("zlib-notice", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", (12, 19)),
    Template("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license", (6, 9)),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), lambda w: w != "")


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of rows, and of those that hold each word: as many sums as there are words."""
    held = docs.select(F.explode(F.array_intersect(words_of(col(text_col)), F.array(*map(F.lit, vocabulary)))).alias("w"))
    found = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return docs.count(), {w: found.get(w, 0) for w in vocabulary}


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE, least: float = 0.8) -> DataFrame:
    """One row per row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place where a base phrase's words stand consecutively, first_word and last_word are the smallest
    and largest of these places' first words (from 0; null without any). labels holds the base labels and those of the
    longer templates found, at any place: a share of ``least`` or more (to nine digits) of a template's IDF in place, and
    its key phrase whole, also where the text's start or end cuts other words off. Both lists are distinct, sorted and
    comma-joined, empty without any. score is the greatest share of what is found, to six digits, 1 for a whole template
    only, 0 for none. Null and empty texts have no words. A table without rows, or without licence words, gives every word
    the same IDF. Other columns are not read.
    """
    templates = [*base, *more]
    vocabulary = sorted({w for t in templates for w in t.words})
    n, df = document_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocabulary}
    rows = docs.select(col(id_col).alias(id_col), words_of(col(text_col)).alias("words"))
    rows = rows.withColumns({"n_words": F.size("words").cast("long"), "have": F.array_intersect("words", F.array(*map(F.lit, vocabulary)))})

    def looked_up(t: Template, share: float) -> Column:
        """The words by which the template is looked up in the file; none if what the file holds of it cannot reach ``share``."""
        total = sum(idf[w] for w in t.words)
        by_idf = sorted({w: None for w in t.words}, key=lambda w: (-idf[w], w))
        each = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(idf[w] * t.words.count(w)).alias("x")) for w in by_idf])
        held = F.filter(each, lambda x: F.array_contains("have", x["w"]))
        none = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("ws"))
        # words that may all be out of place hold 1 - share of the IDF at most
        some = F.aggregate(held, none, lambda s, x: F.when(s["sum"] > (1 - share) * total + 1e-6, s).otherwise(F.struct((s["sum"] + x["x"]).alias("sum"), F.array_append(s["ws"], x["w"]).alias("ws"))))
        enough = F.aggregate(held, F.lit(0.0), lambda s, x: s + x["x"]) >= share * total - 1e-6
        fewest = next(k for k in range(len(by_idf) + 1) if sum(sorted((idf[w] * t.words.count(w) for w in by_idf), reverse=True)[:k]) >= share * total - 1e-6)
        return F.when((F.size("have") >= fewest) & enough, some["ws"]).otherwise(F.array().cast("array<string>"))

    rows = rows.withColumns({f"l{k}": looked_up(t, 1.0 if k < len(base) else least) for k, t in enumerate(templates)})
    rows = rows.withColumn("rare", F.array_distinct(F.concat(*[F.col(f"l{k}") for k in range(len(templates))])))
    # the file's postings of its rarest licence words
    postings = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains("rare", x["w"]))
    rows = rows.withColumn("p", F.when(F.size("rare") > 0, postings))

    def found(k: int, t: Template) -> Column:
        """s (first word), share and whole of each place of the template; null without any word looked up."""
        total, each = sum(idf[w] for w in t.words), [F.struct(F.lit(i).alias("k"), F.lit(w).alias("w"), F.lit(idf[w]).alias("x")) for i, w in enumerate(t.words)]
        places = F.create_map(*[x for w in dict.fromkeys(t.words) for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(t.words) if v == w]))])
        proposed = F.transform(F.filter("p", lambda x: F.array_contains(f"l{k}", x["w"])), lambda x: F.transform(F.element_at(places, x["w"]), lambda i: x["i"] - i))
        stands = lambda s, x: F.coalesce(F.get("words", s + x["k"]) == x["w"], F.lit(False))
        key = F.array(*each[slice(*t.mandatory)])
        starts = F.filter(F.array_distinct(F.flatten(proposed)), lambda s: F.forall(key, lambda x: stands(s, x)))
        part = lambda s: F.aggregate(F.array(*each), F.lit(0.0), lambda y, x: y + F.when(stands(s, x), x["x"]).otherwise(0.0))
        shares = F.transform(starts, lambda s: F.struct(s.alias("s"), F.round(part(s) / total, 9).alias("share"), F.forall(F.array(*each), lambda x: stands(s, x)).alias("whole")))
        return F.when(F.size(f"l{k}") > 0, F.filter(shares, lambda x: x["whole"] if k < len(base) else x["whole"] | (x["share"] >= least)))

    rows = rows.select(id_col, "n_words", *[F.coalesce(found(k, t), F.array().cast("array<struct<s: int, share: double, whole: boolean>>")).alias(f"t{k}") for k, t in enumerate(templates)])
    labels = [F.when(F.size(f"t{k}") > 0, F.lit(t.label)) for k, t in enumerate(templates)]
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    best = F.array_max(F.transform(F.concat(*[F.col(f"t{k}") for k in range(len(templates))]), lambda x: F.when(x["whole"], 1.0).otherwise(F.least(x["share"], F.lit(NEARLY)))))
    return rows.withColumn("places", F.concat(*[F.col(f"t{k}.s") for k in range(len(base))])).select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        listed(labels[: len(base)]).alias("base_labels"),
        listed(labels).alias("labels"),
        F.round(F.coalesce(best, F.lit(0.0)), 6).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: base phrases, their places, labels and score."""
    return scanned(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def oracle_sql(least: float = 0.8) -> str:
    """The same in DuckDB SQL without any index: every place that a word of a template proposes, with all that stands there."""
    rows = [(k, t.label, k < len(BASE), "['" + "', '".join(t.words) + "']", *t.mandatory) for k, t in enumerate([*BASE, *MORE])]
    values = ", ".join(f"({k}, '{label}', {base}, {words}, {a}, {b})" for k, label, base, words, a, b in rows)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH tp(t, label, base, ws, a, b) AS (VALUES {values}),
tw AS (SELECT t, label, base, a, b, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM tp),
d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, row_number() OVER () AS r, [x for x in regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] AS words FROM documents),
df AS (SELECT w, count(d.r) AS df FROM (SELECT DISTINCT w FROM tw) LEFT JOIN (SELECT r, unnest(list_distinct(words)) AS w FROM d) d USING (w) GROUP BY 1),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1 AS idf FROM df),
ti AS (SELECT tw.*, idf, sum(idf) OVER (PARTITION BY t) AS total FROM tw JOIN idf USING (w)),
pos AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
st AS (SELECT r, t, i - k AS s, round(sum(idf) / any_value(total), 9) AS share, count(*) = any_value(n) AS whole, count(*) FILTER (k >= a AND k < b) = any_value(b - a) AS key, any_value(label) AS label, any_value(base) AS base FROM pos JOIN ti USING (w) GROUP BY 1, 2, 3),
sc AS (SELECT *, CASE WHEN whole THEN 1.0 ELSE least(share, {NEARLY}) END AS best FROM st WHERE whole OR NOT base AND key AND share >= {least}),
al AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(best) AS score FROM sc GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score FROM d LEFT JOIN al USING (r)
"""
