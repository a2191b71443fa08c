import math
import random
import re

from pyspark.sql import types as T

from tessera.llm import licenses

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("p", T.StringType()), T.StructField("words", T.StringType())])
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases_against_a_plain_scan(spark):
    rng = random.Random(1)
    bits = ["GNU", "general", "Public", "license", "apache", "CC", "by", "BY-", "MIT", "mit", "licensed", "é", "und", "x9", "\x7f", "v", "Élan"]
    rows = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(bits, k=rng.randint(0, 60))), "a", "b") for i in range(400)]
    rows += [(1000, None, "", ""), (1001, "", "", ""), (None, "MIT License", "", ""), (1002, "word " * 20000 + "Apache-License", "", ""), (1003, "cc by cc by cc by", "", ""), (1003, "cc by", "", "")]
    got = licenses.scanned(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((str(i), *map(str, plain(t))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), *map(str, r[1:6])) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.n_base == 0 or r.score == 1)
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_longer_templates_need_their_key_phrase(spark):
    rows = [
        (1, "Redistribution and use in source and binary forms, with or without changes are permitted", "", ""),
        (2, "Use and redistribution of source and binary forms with or without modification are permitted", "", ""),
        (3, "Licensed under the Apache License, Version 2.0", "", ""),
        (4, "nothing of the kind", "", ""),
    ]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].labels == "bsd" and 0.8 <= got[1].score < 1
    assert got[2].labels == "" and got[2].score < 1
    assert got[3].labels == "apache,apache-2.0" and got[3].base_labels == "apache" and got[3].first_word == 3
    assert got[4].labels == "" and got[4].first_word is None


def test_empty_table(spark):
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_labels(words, templates, n_base, idf, least=0.8):
    """Labels and score from every place, words looked up one by one."""
    labels, best = set(), 0.0
    for k, t in enumerate(templates):
        total = sum(idf[w] for w in t.words)
        for s in range(-len(t.words), len(words)):
            there = [0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(t.words)]
            share = round(sum(idf[w] for w, x in zip(t.words, there) if x) / total, 9)
            if all(there) or k >= n_base and all(there[slice(*t.mandatory)]) and share >= least:
                labels.add(t.label)
                best = max(best, 1.0 if all(there) else min(share, licenses.NEARLY))
    return ",".join(sorted(labels)), round(best, 6)


def test_all_places_against_a_plain_scan(spark):
    """Notices with words changed, cut off and inserted, one after the other: whatever word is missing, what has 0.8 is found."""
    rng = random.Random(4)
    templates = [*licenses.BASE, *licenses.MORE]
    rows = [(0, "redistribution and use in source and binary forms with or without change are permitted")]
    for i in range(1, 300):
        words = []
        for _ in range(rng.randint(0, 3)):
            part = list(rng.choice(templates).words)
            for _ in range(rng.choice([0, 0, 1, 2, len(part) // 6])):
                part[rng.randrange(len(part))] = rng.choice(["changed", "the", "license", "software"])
            words += rng.choices(["the", "of", "lorem", "software", "and"], k=rng.randint(0, 9)) + part[rng.choice([0, 0, 1, 3]) :]
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    split = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for i, t in rows}
    idf = {w: math.log((1 + len(rows)) / (1 + sum(w in x for x in split.values()))) + 1 for t in templates for w in t.words}
    for i, words in split.items():
        assert (got[i].labels, got[i].score) == plain_labels(words, templates, len(licenses.BASE), idf), rows[i]
    assert got[0].labels == "bsd" and sum("," in r.labels for r in got.values()) > 50
