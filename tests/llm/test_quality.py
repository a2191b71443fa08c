import random
import zlib

import numpy as np
from pyspark.sql import types as T

from tessera.llm import quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("x", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"


def walk(model, x):
    total = model.base
    for node in model.roots:
        while model.left[node] != node:
            node = model.left[node] if x[model.feature[node]] <= model.threshold[node] else model.right[node]
        total += model.value[node]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_score_as_a_walk_does_and_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:1000], y[:1000])
    scores = model.score(x[1000:])
    assert np.allclose(scores, [walk(model, r) for r in x[1000:]])
    assert ((scores > 0.5) == (y[1000:] > 0)).mean() > 0.95
    again = quality.fit(x[:1000], y[:1000])
    assert (again.score(x) == model.score(x)).all()


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    words = ["the", "house", "stone", "river", "walk", "green", "light", "seven"]
    rows = []
    for i in range(1200):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(w) + "." if i % 3 else " ".join(x.upper() + "!!" for x in w), "s", "x"))
    rows += [(5000, None, None, None), (5001, "", "", ""), (None, "the house", "", ""), (5002, "a" * 300_000, "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1200)] + [(None, 1, 0), (7, None, 0), (99999, 1, 1)], LABELS)
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.scored(docs, model).withColumn("out", quality.held_out()).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    test = [i for i in range(1200) if got[i].out]
    assert np.mean([(got[i].score >= 0.7) == (i % 3 > 0) for i in test]) > 0.97
    assert got[5000].score == got[5001].score
    kept = quality.filtered(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score >= 0.7}
    # labels of held-out rows have no influence
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    assert (quality.train(docs, flipped).value == model.value).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    model = quality.train(none, spark.createDataFrame([], LABELS))
    assert quality.scored(none, model).collect() == []
    assert model.score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
