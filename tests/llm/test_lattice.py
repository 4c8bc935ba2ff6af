import itertools

import numpy as np

from tapedeck.llm import lattice
from tests.llm.fixtures import SF


def brute(vectors, cosine=0.9):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= cosine
    return {(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(ids), 2) if hit[i, j]}


def test_decoding_finds_the_nearest_point():
    r = np.random.default_rng(1)
    y = r.standard_normal((300, 8)) * 1.5
    points, steps = lattice.nearest_e8(y), lattice.minimal_vectors()
    assert len({tuple(s) for s in steps}) == 240 and {int((s * s).sum()) for s in steps} == {8}
    own = ((2 * y - points) ** 2).sum(axis=1)
    for s in steps:
        assert (((2 * y - points - s) ** 2).sum(axis=1) >= own - 1e-9).all()


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((400, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = r.uniform(0.9001, 0.93, (400, 1))
    y = c * x + np.sqrt(1 - c * c) * z
    vectors = {i: v.tolist() for i, v in enumerate(np.concatenate([x, y]))}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(p.a, p.b) for p in lattice.similar_pairs(df).collect()}
    want = brute(vectors)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_small_table_and_awkward_rows(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/../sf0.01/embeddings.parquet").collect()]
    a, b = rows[0][1], rows[1][1]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None, *a[1:]]), (9006, a), (9007, a), (9007, a), (None, a), (9008, a[:32]), (9009, [float("inf"), *b[1:]]), (9010, [2 * v for v in b])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as a", "2 as rep", "3 as label")
    got = lattice.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows) + len(odd)
    sound = dict(rows) | {i: a for i in (9006, 9007)} | {9010: [2 * v for v in b]}
    pairs = brute(sound)
    n = {i: 0 for i in sound}
    for p in pairs:
        for i in p:
            n[i] += 1
    for r in got:
        if r.vec_id is None:
            assert r.n_links == 0 and r.kept and r.component_id is None
        elif r.vec_id in sound:
            assert r.n_links == n[r.vec_id], r
            assert r.kept == (r.component_id == r.vec_id)
        else:
            assert r.n_links == 0 and r.kept


def test_large_cells_are_cut(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.standard_normal(16) + 0.05 * r.standard_normal((60, 16))
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    monkeypatch.setattr(lattice, "CELL_ROWS", 7)
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert {(p.a, p.b) for p in lattice.similar_pairs(df).collect()} == brute(vectors)


def test_empty_table(spark):
    assert lattice.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
