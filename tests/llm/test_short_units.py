import random

from tessera.llm import substrings

RNG = random.Random(9)


def short(n):
    """Short sentences of one to five words that hold n words or a few more."""
    out, words = [], 0
    while words < n:
        k = RNG.randint(1, 5)
        out.append(" ".join(f"s{RNG.randrange(10**6)}" for _ in range(k)).capitalize() + ".")
        words += k
    return " ".join(out)


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in substrings.deduplicated(docs).collect()}


def test_texts_of_short_lines_and_short_texts(spark):
    verse, values, dense = "\n".join(short(4) for _ in range(20)), "\n".join(f"k{k}: v{RNG.randrange(10**6)}" for k in range(30)), "\n".join(f"漢字{RNG.randrange(10**6)}" for _ in range(40))
    same = "\n".join(["ha ha"] * 60)
    texts = [verse, values, dense, same, "Two words.", "once only"]
    got = kept(spark, [*texts, *texts[:5]])
    assert [got[k] for k in (0, 1, 2, 4, 5)] == [texts[k] for k in (0, 1, 2, 4, 5)] and got[3].startswith("ha ha")
    assert all(got[k] == "" for k in range(6, 11))


def test_short_sentences_between_different_neighbours(spark):
    passages = [short(60) for _ in range(10)]
    long = lambda: " ".join(f"h{RNG.randrange(10**6)}" for _ in range(12)) + "."
    texts = [f"{long()} {p} {long()}" for p in passages] + [f"{short(20)} {p} {short(20)}" for p in passages] + [f"{long()} {p} {long()}" for p in passages]
    got = kept(spark, texts)
    size = {k: len(set(passages[k % 10].lower().split()) & set(t.lower().split())) for k, t in got.items()}
    assert all(got[k] == texts[k] for k in range(10))
    assert all(size[k] == 0 for k in range(20, 30))
    assert sum(size[k] for k in range(10, 20)) <= 0.3 * sum(len(p.split()) for p in passages)


def test_short_lines_by_chance_stay(spark):
    texts = [f"{short(30)}\nYes.\nNo.\n{short(30)}" for _ in range(5)]
    assert list(dict(sorted(kept(spark, texts).items())).values()) == texts
