import random
import re

import numpy as np

from tapedeck.llm import near_dup
from tapedeck.llm.components import components
from tests.llm.fixtures import SF, awkward, edited, frame, prose


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                n = len(sets[x] & sets[y])
                if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                    p, q = sorted((root(x), root(y)))
                    up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, rows, words, extra=True):
    got = near_dup.near_duplicates(frame(spark, rows, extra), words=words).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None], words, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_awkward_rows(spark):
    check(spark, awkward(), 2)
    check(spark, awkward(), 5)


def test_groups_against_brute_force(spark):
    r = random.Random(5)
    rows, i = [], 0
    for g in range(40):
        base = prose(100 + g, r.choice([4, 12, 60, 200]))
        for _ in range(r.choice([1, 2, 3, 12])):
            n = len(base.split())
            rows.append((i, edited(base, r.sample(range(n), r.randint(0, max(1, n // 20))))))
            i += 1
    check(spark, rows, 2)


def test_whole_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows, 2, extra=False)


def test_empty_table(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dup.drop_near_duplicates(frame(spark, [])).count() == 0


def test_drop_keeps_columns_and_first(spark):
    df = frame(spark, awkward())
    out = near_dup.drop_near_duplicates(df)
    assert out.columns == df.columns
    ids = {r.doc_id for r in out.collect()}
    assert {0, 1, 2, 6, None} <= ids and 7 not in ids and 8 not in ids


def test_components_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(500)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star + [(7, 7), (None, 3)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(501)} | {1000 + i: 1000 for i in range(300)}


def star(n, seed=31, words=200, edits=8):
    """n copies, each alike enough to the original (in the middle) and too unlike each other."""
    r, base = random.Random(seed), [f"w{i}" for i in range(words)]
    rows = [(i, " ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(base))) for i in range(n) for at in [set(r.sample(range(1, words - 1, 3), edits))]]
    rows[n // 2] = (n // 2, " ".join(base))
    return rows


def test_star_of_edited_copies(spark):
    rows = star(1000)
    got = near_dup.near_duplicates(frame(spark, rows, False), words=2).collect()
    assert len(got) == 1000 and {r.component_id for r in got} == {0}


def test_many_rows_of_a_shingle_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "NEIGHBOURS", 1)
    rows = star(150)
    assert {r.component_id for r in near_dup.near_duplicates(frame(spark, rows, False), words=2).collect()} == {0}


def test_bitmaps_never_differ_more_than_sets():
    r = np.random.default_rng(2)
    for n, m, k in ((1, 1, 0), (40, 45, 30), (200, 160, 150), (900, 90, 90)):
        x = r.integers(0, 2**63, n + m - k).astype(np.uint64)
        a, b = x[:n], x[n - k :]
        assert near_dup.differ(near_dup.bitmap(a), near_dup.bitmap(b)) <= n + m - 2 * k


def test_drop_with_columns_of_any_name(spark):
    df = frame(spark, [(1, prose(3, 40)), (2, prose(3, 40))]).selectExpr("*", "'m' as `a.b`", "5L as gone_doc_id")
    out = near_dup.drop_near_duplicates(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]
