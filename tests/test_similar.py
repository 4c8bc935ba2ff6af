import random
import re

import pytest

from tapedeck.operators import similar


def brute(rows, threshold, n=5):
    sets = {}
    for i, t in rows:
        w = [x for x in re.sub("[^a-z0-9_]+", " ", (t or "").lower()).split() if x]
        if i is not None and len(w) >= n:
            sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    out = {(first[s], i, 1.0, True) for i, s in sets.items() if first[s] != i}
    reps = sorted(first.values())
    for x, a in enumerate(reps):
        for b in reps[x + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= threshold:
                out.add((a, b, round(j, 6), False))
    return out


def some(seed, families=8, variants=7, longest=60):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(families):
        base = [f"w{int(40 * r.random() ** 2)}" for _ in range(r.randint(5, longest))]
        for _ in range(variants):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
                w[r.randrange(len(w))] = f"x{r.randrange(9)}"
            rows.append((i := i + 1, " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, "only four words here"), (903, "One two, three FOUR five!"), (904, "one TWO three four five"), (None, rows[0][1])]


def got(spark, rows, threshold):
    df = spark.createDataFrame(rows, "uri long, lyrics string").selectExpr("*", "1 as id", "2 as a", "3 as n", "4 as token")
    return {tuple(r) for r in similar.similar_lyrics(df, id="uri", text="lyrics", threshold=threshold).collect()}


@pytest.mark.parametrize("threshold", [0.8, 0.5, 0.1, 1.0])
def test_against_all_pairs(spark, threshold):
    rows = some(int(threshold * 10))
    want = brute(rows, threshold)
    assert want and got(spark, rows, threshold) == want


def test_hot_shingles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    rows = some(5, families=3, variants=20)
    assert got(spark, rows, 0.6) == brute(rows, 0.6)


def test_empty_table_and_thresholds(spark):
    assert got(spark, [], 0.8) == set()
    with pytest.raises(ValueError):
        got(spark, [], 0)


def test_words_of_texts_unlike_others_are_not_written(spark, monkeypatch):
    """Shingles that one text has alone go into no table in between."""
    written, cut = [], similar.cut

    def seen(df):
        out = cut(df)
        lists = [c for c, t in out.dtypes if t.startswith("array")]
        written.append(sum(1 + sum(len(r[c]) for c in lists) for r in out.collect()))
        return out

    monkeypatch.setattr(similar, "cut", seen)
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(50_000)}" for _ in range(300))) for i in range(50)]
    assert got(spark, [*rows, (99, rows[7][1] + " end")], 0.8) == {(7, 99, round(296 / 297, 6), False)}
    assert sum(written) < 51 * 300 / 10


def test_nearest_are_those_of_all_pairs_and_odd_vectors_are_like_nothing(spark):
    import numpy as np

    from tapedeck.operators import lyrics as ly

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(70, 5)), 1)
    x[:4] = [[0] * 5, x[10], x[10], 2 * x[10]]
    nan, inf = float("nan"), float("inf")
    odd = [(100, [nan, 1.0, 1.0, 1.0, 1.0]), (101, [None, 1.0, 1.0, 1.0, 1.0]), (102, [inf, 0.0, 0.0, 0.0, 0.0]), (103, None)]
    df = spark.createDataFrame([*enumerate(x.tolist()), *odd], "id long, v array<double>")
    ids, rows = [*range(70), 100, 101, 102], np.vstack([x, np.zeros((3, 5))])
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    cosine = np.round(unit @ unit.T, 6)
    want = set()
    for q in (0, 1, 10, 50, 70):
        best = sorted((-cosine[q, i] + 0.0, ids[i]) for i in range(73) if i != q)[:7]
        want |= {(ids[q], m, round(-c, 6) + 0.0, k + 1) for k, (c, m) in enumerate(best)}
    for block in (8, 8192):
        got = ly.nearest(df, df.where("id in (0, 1, 10, 50, 100, 103)"), id="id", vector="v", k=7, block_rows=block).collect()
        assert {(r["query"], r["match"], r["cosine"] + 0.0, r["rank"]) for r in got} == want
    assert ly.nearest(df.limit(0), df, id="id", vector="v").count() == 0
