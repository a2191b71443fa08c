import random

from tessera.llm import substrings

RNG = random.Random(11)


def sentence(n):
    return " ".join(f"w{RNG.randrange(10**6)}" for _ in range(n)) + "."


def test_a_line_goes_whatever_its_length(spark):
    lines = [sentence(6), sentence(7) + " Two more.", sentence(9), sentence(12) + " Short end."]
    texts = [f"{sentence(20)}\n{lines[k % 4]}\n{sentence(20)}" for k in range(40)]
    inside = [f"{sentence(20)}\n{lines[0][:-1]} {sentence(20)}", f"{sentence(20)}\n{lines[2]} {sentence(20)}"]
    docs = spark.createDataFrame(list(enumerate([*texts, *inside])), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substrings.deduplicated(docs).collect()}
    assert all(got[k].text == texts[k] and not got[k].removed for k in range(4))
    for k in range(4, 40):
        assert got[k].text == texts[k].replace(lines[k % 4] + "\n", "")
        assert [x.kept_id for x in got[k].removed] == [k % 4]
    assert all(got[40 + k].text == t for k, t in enumerate(inside))  # part of a line: the minimum holds

