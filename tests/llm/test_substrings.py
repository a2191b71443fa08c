import random
import re

import pytest
from pyspark.sql import types as T

from tessera.llm import substrings

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("_hash2", T.StringType())])
RNG = random.Random(5)


def sentence(n):
    return " ".join(f"w{RNG.randrange(10**6)}" for _ in range(n)).capitalize() + "."


def mark(word):
    """The hash that says where units end, word by word."""
    x, power = 0, 1
    for k, c in enumerate(word):
        power = power * 0x9E3779B97F4A7C15 % 2**64 if k % 64 else 0x9E3779B97F4A7C15
        x += (ord(c) + 1) * power
    x = (x % 2**64 ^ x % 2**64 >> 31) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32 if word else 2**64 - 1


def plain_units(text, long_unit=4, long_sentence=6, around=3):
    """(start, normal words, line or None, key) of each unit; the key of a unit that never goes is None."""
    low = "".join(x if len(x := c.lower()) == 1 else c for c in text) if len(text.lower()) != len(text) else text.lower()
    found = [(m.start(), low[m.start() : m.end()], text.count("\n", 0, m.start())) for m in re.finditer(r"\S+", text)]
    words = [w.strip(".,;:!?()[]{}\"'") for _, w, _ in found]
    last = len(found) - 1
    sentence_ends = [i for i, (_, w, line) in enumerate(found) if i == last or found[i + 1][2] != line or w[-1] in ".!?"]
    pieces, begin = [], 0  # (first word, end, part of a cut sentence)
    for e in sentence_ends:
        marks = [mark(w) for w in words[begin : e + 1]]
        inner = [begin + k for k in range(around, len(marks) - around - 1) if all(marks[k] < marks[j] for j in range(k - around, k + around + 1) if j != k)]
        edges = [begin, *[i + 1 for i in inner], e + 1]
        pieces += [(a, b, bool(inner)) for a, b in zip(edges, edges[1:])]
        begin = e + 1
    count = lambda a, b: sum(map(bool, words[a:b]))
    per_line = {}
    for (_, _, line), w in zip(found, words):
        per_line[line] = per_line.get(line, 0) + bool(w)
    line_of = lambda a: found[a][2] if per_line[found[a][2]] >= long_unit else None
    units, k = [], 0  # first word, end, kind
    while k < len(pieces):
        a, b, part = pieces[k]
        if count(a, b) >= long_sentence or part and count(a, b):
            units.append((a, b, "own"))
            k += 1
            continue
        run = [pieces[k]]
        while k + len(run) < len(pieces):
            c, d, p = pieces[k + len(run)]
            if count(c, d) >= long_sentence or p and count(c, d) or line_of(c) != line_of(a):
                break
            run.append(pieces[k + len(run)])
        k += len(run)
        if count(run[0][0], run[-1][1]) < long_unit:
            units.append((run[0][0], run[-1][1], "rest"))
            continue
        sizes = [count(c, d) for c, d, _ in run]
        marks = [min(mark(w) for w in words[c:d]) if n else 2**64 for (c, d, _), n in zip(run, sizes)]
        ends = [0]
        for j in range(len(run) - 1):
            left = next((marks[i] for i in range(j - 1, -1, -1) if sizes[i]), 2**65)
            right = next((marks[i] for i in range(j + 1, len(run)) if sizes[i]), -1)
            if sizes[j] and left > marks[j] < right and sum(sizes[ends[-1] : j + 1]) >= long_unit:
                ends.append(j + 1)
        if len(ends) > 1 and sum(sizes[ends[-1] :]) < long_unit:
            ends.pop()
        ends = ends[1:]
        for x, y in zip([0, *ends], [*ends, len(run)]):
            while True:
                z = next((z for z in range(x, y) if sum(sizes[x : z + 1]) >= 16), None)
                if z is None or sum(sizes[z + 1 : y]) < 16:
                    break
                units.append((run[x][0], run[z][1], "own"))
                x = z + 1
            units.append((run[x][0], run[y - 1][1], "own"))
    form = lambda u: tuple(w for w in words[u[0] : u[1]] if w)
    out = []
    for k, u in enumerate(units):
        line, key = line_of(u[0]), form(u)
        if u[2] == "rest" and len(units) > 1:
            sides = []
            for j in (k - 1, k + 1):
                inside = 0 <= j < len(units)
                if line is None:
                    sides.append(form(units[j]) if inside else None)
                else:
                    sides.append(form(units[j]) if inside and line_of(units[j][0]) == line else "line")
            key = ("between", sides[0], key, sides[1]) if key and None not in sides else None
        out.append((0 if k == 0 else found[u[0]][0], form(u), line, key))
    return out


def plain(rows, least_words=10, least_line=6):
    """(id, text) -> what stays and the spans, one document after the other in the order of ranks; ids are distinct."""
    first, out = {}, {}
    for i, text in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        units = plain_units(text)
        kept = {}
        for k, (_, _, _, key) in enumerate(units):
            if key is not None and first.setdefault(key, (i, k)) != (i, k):
                kept[k] = first[key]
        goes, k = set(), 0
        while k < len(units):
            end = k
            while end < len(units) and end in kept:
                end += 1
            run = range(k, end)
            if sum(len(units[j][1]) for j in run) >= least_words or len(run) == len(units):
                goes |= set(run)
            for line in {units[j][2] for j in run} - {None}:
                whole = [j for j, u in enumerate(units) if u[2] == line]
                if set(whole) <= set(run) and sum(len(units[j][1]) for j in whole) >= least_line:
                    goes |= set(whole)
            k = max(end, k + 1)
        spans = []
        for j in sorted(goes):
            start, end = units[j][0], units[j + 1][0] if j + 1 < len(units) else len(text)
            if j - 1 in goes and (kept[j - 1][0], kept[j - 1][1] + 1) == kept[j]:
                spans[-1] = (spans[-1][0], end, kept[j][0])
            else:
                spans.append((start, end, kept[j][0]))
        stays, at = "", 0
        for a, b, _ in spans:
            stays, at = stays + text[at:a], b
        out[i, text] = (stays + text[at:], spans)
    return out


def normal(text):
    return " " + " ".join(x for w in text.lower().split() if (x := w.strip(".,;:!?()[]{}\"'"))) + " "


def check(texts, got):
    """What holds of any result (id -> text that stays, spans): spans and texts fit, and each span stands whole in what its kept document keeps."""
    for i, (stays, spans) in got.items():
        kept, at = "", 0
        for a, b, k in spans:
            assert a >= at and normal(texts[i][a:b]) in normal(got[k][0])
            kept, at = kept + texts[i][at:a], b
        assert stays == kept + texts[i][at:]


def deduplicated(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in substrings.deduplicated(docs, **options).collect()}


def test_passages_lines_and_copies(spark):
    passage = " ".join([sentence(14), "As.", sentence(9), sentence(20)])
    common = sentence(16)
    rows = [(k, "\n".join([sentence(8), common, sentence(5) + " " + passage + " " + sentence(11), "The."])) for k in range(30)]
    rows += [(100 + k, rows[0][1]) for k in range(50)] + [(200, None), (201, ""), (202, "The. As. The."), (203, passage.upper())]
    rows += [(300 + k, sentence(30) + "\n" + sentence(4)) for k in range(5)]
    RNG.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(7)
    got = substrings.deduplicated(frame)
    assert got.columns == [*frame.columns, "removed"]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(rows)
    for (i, text), (kept, spans) in plain(rows).items():
        assert got[i].text == kept and [tuple(x) for x in got[i].removed] == spans
    check(dict(rows), {i: (r.text, [tuple(x) for x in r.removed]) for i, r in got.items() if r.text is not None})
    assert got[200].text is None and got[200].removed == []
    assert passage in got[0].text and all(passage not in got[k].text for k in range(1, 30))
    assert all(x.kept_id == 0 for k in range(1, 30) for x in got[k].removed)
    assert all(not got[300 + k].removed for k in range(5)) and not got[202].removed
    assert got[100].text.strip() == "The."


def test_passages_inside_sentences_go_as_a_whole(spark):
    passage = " ".join(f"p{k}" for k in range(60)) + ". " + " ".join(f"q{k}" for k in range(25))
    host = lambda: " ".join(f"h{RNG.randrange(10**6)}" for _ in range(30))
    rows = [(k, f"{host()} {passage} {host()}", "", "") for k in range(6)]
    got = {r.doc_id: r for r in substrings.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == rows[0][1]
    for k in range(1, 6):
        left = got[k].text.split()
        assert sum(w[0] in "pq" for w in left) <= 20 and sum(w[0] == "h" for w in left) == 60
        ((start, end, kept),) = got[k].removed
        assert kept == 0 and got[k].text == rows[k][1][:start] + rows[k][1][end:]


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = sentence(20)
    got = substrings.deduplicated(spark.createDataFrame([(None, text, "", ""), (3, text, "", ""), (3, text, "", "")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, len(r.removed)) for r in got) == [(-1, 1), (3, 0), (3, 0)]
    # texts of one id that hold each other: either the whole one or what it shares with the other stays
    got = substrings.deduplicated(spark.createDataFrame([(None, text, "", ""), (3, text, "", ""), (3, text, "", ""), (3, "other " + text, "", "")], SCHEMA)).collect()
    by_id = sorted((r.doc_id or -1, r.text) for r in got)
    assert by_id[0] == (-1, "") and all(x.kept_id == 3 for r in got for x in r.removed)
    stays = [t for i, t in by_id if i == 3]
    assert stays.count(text) == 2 and "other " + text not in stays or "other " + text in stays and stays.count(text) == 0 and len(set(stays)) == 2
    assert substrings.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_random_texts_against_plain_python(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdé,.!Ü-", k=rng.randint(1, 5))) for _ in range(60)] + ["a.", "no!", "(x", "İx", "ΑΣ", "...", "-"]
    stock = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(60)]
    texts = {}
    for i in range(400):
        parts = [rng.choice(stock) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(rng.randint(0, 8))]
        texts[i] = "".join(p + rng.choice(["\n", " ", ". ", "\n\n", "\t"]) for p in parts)
        if rng.random() < 0.1 and i:
            texts[i] = rng.choice([texts[rng.randrange(i)], texts[rng.randrange(i)].upper(), " " + texts[rng.randrange(i)]])
    got = deduplicated(spark, texts)
    want = plain(list(texts.items()))
    assert got == {i: want[i, t] for i, t in texts.items()}
    check(texts, got)
    assert sum(bool(s) for _, s in got.values()) > 100


def test_words_beside_a_repeat_stay(spark):
    """Words next to a repeated unit go only if they repeat themselves, whatever their short hashes say."""
    unit = sentence(12)
    texts = {1: f"zz yy xx red361 blue361. {unit}", 2: f"tt ss rr red411 blue411. {unit}"}
    got = deduplicated(spark, texts)
    assert got == {1: (texts[1], []), 2: ("tt ss rr red411 blue411. ", [(25, len(texts[2]), 1)])}


def test_a_kept_unit_is_never_cut(spark):
    w, v = " ".join(f"w{k}" for k in range(11)), " ".join(f"v{k}" for k in range(10)) + "."
    texts = {1: f"alpha {w}. {v}", 5: f"beta {w}. {v}", 9: f"beta {w}. other words come at the end of this one here."}
    got = deduplicated(spark, texts)
    assert got == {i: plain(list(texts.items()))[i, t] for i, t in texts.items()}
    check(texts, got)
    sentences = [f"beta {w}", v[:-1], f"alpha {w}", "other words come at the end of this one here"]
    assert all(any(f" {s} " in normal(t) for t, _ in got.values()) for s in sentences)


def test_each_span_names_the_document_that_keeps_it(spark):
    a, b = sentence(12), sentence(13)
    texts = {3: f"{a}\n{sentence(9)}", 4: f"{b}\n{sentence(9)}", 7: f"{a}\n{b}\n{sentence(9)}"}
    got = deduplicated(spark, texts)
    assert [x[2] for x in got[7][1]] == [3, 4]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_tables_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in substrings.deduplicated(docs).collect()}
    want = plain(list(texts.items()))
    assert got == {i: want[i, t] for i, t in texts.items()}
    check(texts, got)


def test_later_copies_of_benchmark_passages_go(spark):
    """Of passages that stand in several documents of the 0.1 tables, all later copies of over 50 words lose three quarters at least, and nine in ten of all copies lose most."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: normal(r.text) for r in docs.collect()}
    left = {r.doc_id: normal(r.text) for r in substrings.deduplicated(docs).collect()}
    copies = []
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = normal(r.text).split()
        inner = " ".join(words[1:-1]) if len(words) > 4 else " ".join(words)
        parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
        copies += [(len(words), sum(p not in left[i] for p in parts) / len(parts)) for i in sorted(i for i, t in texts.items() if f" {inner} " in t)[1:]]
    assert len(copies) >= 100
    assert all(share >= 0.75 for n, share in copies if n > 50)
    assert sum(share > 0.5 for _, share in copies) >= 0.9 * len(copies)


def test_clashing_names_stay(spark):
    rows = [(k, "same words stand in all of these few rows again and again", *[str(k)] * 10) for k in range(3)]
    names = ["doc_id", "text", "_hash", "_rank", "_units", "removed", "hash", "id", "no_id", "spans", "_SPANS", "kept"]
    docs = spark.createDataFrame(rows, names)
    got = {r.doc_id: r for r in substrings.deduplicated(docs, spans_col="_cut").collect()}
    assert list(got[0].asDict()) == [*names, "_cut"] and got[2].text == "" and got[2].removed == "2" and got[1]._rank == "1"
    replaced = substrings.deduplicated(docs)
    assert sorted(replaced.columns) == sorted(names) and {r.doc_id: len(r.removed) for r in replaced.collect()} == {0: 0, 1: 1, 2: 1}


def test_hot_rows_and_other_id_types(spark):
    text = sentence(20)
    docs = spark.createDataFrame([("7", text)] * 500 + [("8", text)] * 500 + [("x", text)], "doc_id string, text string").where("doc_id <> 'x'")
    got = substrings.deduplicated(docs).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text): r["count"] for r in got} == {("7", text): 500, ("8", ""): 500}
