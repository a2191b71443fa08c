import numpy as np
from pyspark.sql import types as T

from tessera.llm import neighbours

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType()), T.StructField("c", T.StringType())])


def plain(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            near = sorted(((-float(neighbours.inner(v[None], w[None])[0]), j) for j, w in rows if j != i and len(w) == len(v)))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def collected(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    return got


def test_exact_against_brute_force(spark, monkeypatch):
    for name, n in (("QUERY_BLOCK", 16), ("CANDIDATE_BLOCK", 100), ("TILE", 32)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[7]  # a hot vector
    x[::5] *= np.float32(1e-12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0] * 3), (1061, [2.0, 0.0, -1.0]), (1080, [float("inf")] * 16), (1100, [None] * 16), (1120, []), (None, [1.0] * 16)]
    got = collected(neighbours.nearest(spark.createDataFrame([(i, v, "r", "c") for i, v in rows], SCHEMA).repartition(4)))
    want = plain(rows, 20)
    assert got.keys() == {i for i, near in want.items() if near}
    for i, near in got.items():
        assert [j for j, _ in near] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in near], [s for _, s in want[i]], rtol=1e-12, atol=0)


def test_few_candidates_repeats_and_none(spark):
    rows = [(0, [1.0, 0.0], "", ""), (0, [1.0, 0.0], "", ""), (1, [0.5, 0.5], "", ""), (2, [0.5, 0.5], "", "")]
    assert collected(neighbours.nearest(spark.createDataFrame(rows, SCHEMA))) == {0: [(1, 0.5), (2, 0.5)]}
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bound_holds():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(50, 40)) * rng.lognormal(0, 3, (50, 1)), rng.normal(size=(60, 40)) ** 3
    q8, qs, qw, qe = neighbours.quantised(q)
    c8, cs, cw, ce = neighbours.quantised(c)
    near = neighbours.product(q8, c8) * qs[:, None] * cs
    assert (abs(near - q @ c.T) <= qe[:, None] * cw + (qw + qe)[:, None] * ce + 1e-9 * (qw[:, None] * cw)).all()
    assert (neighbours.product(q8, c8) == q8.astype(int) @ c8.astype(int).T).all()
