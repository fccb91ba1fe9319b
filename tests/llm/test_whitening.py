"""Whitening against numpy's eigenvectors and exact whole-number deviations."""

import math
import random

import numpy as np

from tracemill.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, x string"


def table_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in vectors], SCHEMA)


def plain(vectors, most):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    away = n * x - s
    y = away.astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:most]
    return (away**2).sum(axis=1), y @ v[:, order] / np.sqrt(e[order]), e[order] / (float((away**2).sum()) / n**3)


def check(spark, vectors, most, fine):
    got = whitening.whiten(table_of(spark, vectors), most=most).collect()
    deviation, white, explained = plain([v for _, v in fine], most)
    assert [r["vec_id"] for r in sorted(got, key=lambda r: (r["vec_id"] is not None, r["vec_id"]))] == sorted((i for i, _ in fine), key=lambda i: (i is not None, i))
    by = {}
    for (i, _), d, w in zip(fine, deviation, white):
        by.setdefault(i, []).append((int(d), w))
    signs = None
    for r in got:
        assert (r["n"], r["identity_error"] <= 1e-4) == (len(fine), True)
        assert np.allclose(r["explained"], explained, rtol=1e-6)
        near = [w for d, w in by[r["vec_id"]] if d == r["deviation"] and np.allclose(np.abs(w), np.abs(r["whitened"]), atol=1e-6)]
        assert near
        if signs is None and r["vec_id"] == 1:
            signs = np.sign(near[0] * np.array(r["whitened"]))
    for r in got:
        assert any(np.allclose(w * signs, r["whitened"], atol=1e-6) for _, w in by[r["vec_id"]])


def test_matches_numpy_with_bad_rows_ties_and_repeats(spark):
    rng = random.Random(2)
    mix = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(9)]
    vector = lambda: [sum(rng.gauss(0, 0.3 * (k + 1)) * m for k, m in enumerate(row)) for row in mix]
    fine = [(i, vector()) for i in range(200)]
    fine += [(7, fine[7][1]), (7, vector()), (None, vector())]
    bad = [(900, None), (901, [None] + [0.5] * 8), (902, [float("nan")] * 9), (903, [float("inf")] + [0.1] * 8), (904, []), (905, [1.0] * 4)]
    check(spark, fine + bad, 32, fine)
    check(spark, fine + bad, 3, fine)


def test_more_dimensions_than_components(spark):
    rng = random.Random(4)
    fine = [(i, [rng.gauss(0, 0.2 + k / 40) for k in range(40)]) for i in range(300)]
    check(spark, fine, 32, fine)


def test_rank_empty_and_alike(spark):
    rng = random.Random(5)
    line = [(i, [k / 64, 2 * k / 64, 0.25]) for i in range(50) for k in [rng.randrange(-40, 40)]]
    got = whitening.whiten(table_of(spark, line)).collect()
    assert {len(r["whitened"]) for r in got} == {1} and abs(got[0]["explained"][0] - 1) < 1e-9
    assert whitening.whiten(table_of(spark, [])) is None
    assert whitening.whiten(table_of(spark, [(1, [0.5, 0.25])] * 5)) is None
    assert whitening.whiten(table_of(spark, [(1, [0.5, 0.25])])) is None


def test_wide_numbers_stay_exact(spark):
    vectors = [(1, [3e12, 1.0]), (2, [-3e12, 2.0]), (3, [1e9, -3.5]), (4, [float(np.float32(1e30)), 0.0])]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(table_of(spark, vectors)).collect()}
    large = lambda c: max(-(1 << 40), min(1 << 40, math.floor(64 * float(np.float32(c))))) + 1_000_000
    x = {i: [large(c) for c in v] for i, v in vectors}
    s = [sum(v[k] for v in x.values()) for k in range(2)]
    assert got == {i: sum((4 * v[k] - s[k]) ** 2 for k in range(2)) for i, v in x.items()}


def test_query(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["op13_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    src = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, explained = plain([r["embedding"] for r in src], 32)
    assert len(rows) == 32 * len(src)
    at = {r["vec_id"]: k for k, r in enumerate(src)}
    signs = {}
    for r in sorted(rows, key=lambda r: -abs(r["whitened"])):
        k, c = at[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == deviation[k] and abs(r["explained"] / explained[c] - 1) < 1e-6 and r["identity_error"] < 1e-4
        sign = signs.setdefault(c, math.copysign(1, white[k][c] * r["whitened"]))
        assert abs(white[k][c] * sign - r["whitened"]) < 1e-6
